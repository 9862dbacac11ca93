import random

import __spark_entry__
import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    line = lambda n: " ".join(f"{rng.choice('abcdef')}{rng.randrange(10**5)}" for _ in range(n))
    passage = line(60)
    rows, labels = [], []
    for i in range(240):
        body = [line(30) for _ in range(5)]
        bad = i % 6 == 0
        if bad:
            body[2] += " vile scum idiot filth vile"
        if i % 10 == 3:
            body.insert(2, passage)
        rows.append([i, "\n".join(body), "en", f"s{i % 4}"])
        labels.append((i, 1, int(bad)))
    near = rows[7][1].split(" ")
    near[20] = "changed"
    rows += [[900, rows[5][1], "en", "s1"], [901, " ".join(near), "en", "s2"], [902, None, "en", None]]
    d = str(tmp_path)
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = docs.collect()
        assert docs.columns == cols or name == "bpe"
    clean = {r[0] for r in rows if r[0] % 6 or r[0] >= 900}
    kept = {r.doc_id for r in seen["toxicity"]}
    assert len(kept & clean) >= 0.99 * len(clean) and len(kept - clean) <= 2
    assert sum(passage in (r.text or "") for r in seen["line dedup"]) == 1
    assert 900 not in {r.doc_id for r in seen["line dedup"]}
    assert {r.doc_id for r in seen["simhash"]} <= {r.doc_id for r in seen["line dedup"]}
    total = sum(len((r.text or "").split()) for r in seen["simhash"])
    assert abs(sum(len(r.text.split()) for r in seen["mixing"]) - total) <= 5
    assert len(seen["bpe"]) == len(seen["mixing"]) and all(len(r.ids) == r.n_tokens for r in seen["bpe"])
    assert corpus_pipeline.run(spark, d).count() == len(seen["bpe"])


def test_registered():
    q = __spark_entry__.queries()
    assert "pipeline" in q and all(any(k.startswith(f"op{n}_") for k in q) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(q)
