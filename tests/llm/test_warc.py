import hashlib
import io
import uuid

import pytest

from symgraph.llm import warc
from symgraph.llm.common import shared_dir


def brute(pages):
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    out, groups = [], {}
    for p, _, h in pages:
        groups.setdefault(sha(h), []).append(p)
    seen = set()
    for p, _, h in sorted(pages, key=lambda x: (x[0] is None, x[0] or 0)):
        known = [x for x in groups[sha(h)] if x is not None]
        first = min(known) if known else None
        lead = size(h) < 100 or (p == first and sha(h) not in seen)
        seen.add(sha(h))
        out.append((p, size(h), sha(h), "response" if lead else "revisit", None if lead else first))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    big, short = "ü" * 200, "x" * 99
    pages = [(i, f"http://h/{i}", f"<html>{'page ' * 30}{i}</html>") for i in range(60)]
    pages += [(100 + i, "http://d", big) for i in range(20)] + [(99, "http://d", big), (99, "http://d", big), (200, None, short), (201, "u", short), (202, "u\r\nX-Page-ID: 7", None), (203, "", ""), (None, "n", big), (None, "n", "y" * 150), (204, "l", "z" * 300000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted([tuple(r) for r in warc.op8_warc(df).collect()], key=str)
    assert got == brute(pages)
    assert warc.op8_warc(df.limit(0)).count() == 0


def test_manifest_and_small_archives(spark):
    base = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(i, "u", f"{'text ' * 400}{i}") for i in range(500)], "page_id long, url string, html string")
    m = warc.write_archives(df, base, archive_bytes=2000)
    rows = m.collect()
    assert sum(r.records for r in rows) == 500 and len(rows) > 1
    assert sum(r.bytes for r in rows) < 500 * 2000 / 4
    assert warc.read_archives(m, base).count() == 500


def test_archive_layout():
    out = io.BytesIO()
    out.close, keep = lambda: None, out.close
    w = warc.Writer(out)
    raw = [warc.record("response", i, "http://a b", "d", b"x" * i, None, 1) for i in range(40)]
    for r in raw:
        w.write(r)
    w.close()
    data = out.getvalue()
    assert data[:4] == warc.DICT_MAGIC and list(warc.read(io.BytesIO(data))) == raw
    fields, http, payload = warc.parse(raw[7])
    assert (fields["WARC-Target-URI"], fields["X-Page-ID"], http["Content-Length"], payload) == ("http://a%20b", "7", "7", b"x" * 7)
    with pytest.raises(ValueError):
        list(warc.read(io.BytesIO(data[:-3])))
    with pytest.raises(ValueError):
        list(warc.read(io.BytesIO(b"no dictionary")))
    keep()
