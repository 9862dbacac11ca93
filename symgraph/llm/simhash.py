"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import arrow, connected_components, cut

BITS = 64
#: Buckets with more distinct fingerprints than this are joined through midpoints.
HOT_BUCKET = 64


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over 64 bits. Bit i carries a vector m(i) of
    radius+1 bits; mask v (any nonzero vector) holds the bits with <m(i), v> odd.
    For any ``radius`` positions some nonzero v is orthogonal to all their
    vectors, so fingerprints differing only there agree under that mask."""
    top = 2 ** (radius + 1)
    carried = [i % (top - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (carried[i] & v).bit_count() % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def simhash(text: bytes | None) -> int:
    """The fingerprint of one text, unsigned. See ``fingerprints``."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    buf = b" ".join(words)
    if len(words) <= 3:
        return xxhash.xxh64_intdigest(buf, 42)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:-2].tolist()
    slices = map(buf.__getitem__, map(slice, starts, ends[2:].tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, slices, repeat(42)), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter(map(simhash, b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def _simhash_series(texts: pd.Series) -> pd.Series:
    return pd.Series(np.fromiter(map(simhash, texts), np.uint64, len(texts)).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, fp long)``: the 64-bit SimHash of each whole text over its
    3-word shingles (A-Z lower-cased; fewer words: one shingle of all; null or
    blank text: zero)."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return picked.transform(arrow, _fingerprint_batches, "doc_id long, fp long")


def near_pairs(fps: DataFrame, radius: int = 2, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct fingerprints ``fps(fp)`` that
    differ in 1 to ``radius`` bits; every such pair, each once.

    Buckets of a masked value are joined with themselves if they hold at most
    ``hot`` fingerprints. In a larger one, each fingerprint is sent to all values
    within ceil(radius/2) flips outside the mask: two that differ in up to
    ``radius`` bits meet at a midpoint, and the number of distinct fingerprints
    at one midpoint is bounded by the number of flips. So no group grows with
    the data, and nothing is dropped.
    """
    if not 1 <= radius <= 4:
        raise ValueError("radius must be from 1 to 4")
    masks = covering_masks(radius)
    spark = fps.sparkSession
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])
    keyed = fps.select("fp", F.posexplode(keys).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["t", "key"]))
    near = f"a < b and bit_count(a ^ b) <= {radius}"

    small = shared.where(F.col("n") <= hot)
    from_small = small.select("t", "key", F.col("fp").alias("a")).join(small.select("t", "key", F.col("fp").alias("b")), ["t", "key"]).where(near)

    bits = [0, *(sum(1 << i for i in c) for k in range(1, (radius + 1) // 2 + 1) for c in combinations(range(BITS), k))]
    flips = spark.createDataFrame([(t, _signed(x)) for t, m in enumerate(masks) for x in bits if not x & m], "t int, flip long")
    # Bounded by the radius alone: 7 x about 28 rows for radius 2.
    mids = shared.where(F.col("n") > hot).join(F.broadcast(flips), "t").select("t", "key", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp")
    from_hot = mids.withColumnRenamed("fp", "a").join(mids.withColumnRenamed("fp", "b"), ["t", "key", "mid"]).where(near)
    return from_small.select("a", "b").unionByName(from_hot.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, hot: int = HOT_BUCKET) -> DataFrame:
    """``(doc_id, fp, n_near, component_id)`` for every row of ``docs``: number of
    other rows within ``radius`` bits, and the smallest id reachable over such
    links. Null ids take part in counts but never name a component unless all its
    ids are null; a repeated id counts as one document per row; blank texts link
    with each other; ties of ids don't arise, since equal fingerprints are one; a very
    long text is hashed whole, in memory linear in its words; an empty table gives no
    rows. Only the two columns named are read, so others may have any name.

    Copies collapse to one fingerprint before any join, so a group of copies,
    however large, costs one row; its members are only counted.
    """
    return _grouped(docs, id_col, text_col, radius, hot).drop("node")


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int, hot: int = HOT_BUCKET) -> DataFrame:
    """The rows of ``near_duplicates``, and ``node``, a fingerprint that names the
    component also where another has the same smallest id."""
    each = cut(fingerprints(docs, id_col, text_col))
    g = cut(each.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")))
    pairs = cut(near_pairs(g.select("fp"), radius, hot))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(g.select(F.col("fp").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("linked"))
    cc = connected_components(pairs)
    least = cc.join(g.select(F.col("fp").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    found = linked.join(cc.withColumnRenamed("node", "a"), "a").join(least, "component").select(F.col("a").alias("fp"), "linked", "least", F.col("component").alias("root"))
    per_fp = g.join(found, "fp", "left").select(
        "fp", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_near"), F.coalesce("least", "rep").alias("component_id"), F.coalesce("root", "fp").alias("node")
    )
    return each.join(per_fp, "fp").select("doc_id", "fp", "n_near", "component_id", "node")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row of
    its smallest id stays, of several that one with the smallest fingerprint. Rows
    of other components with the same id are judged on their own. Rows with a null
    id stay too."""
    found = cut(_grouped(docs, id_col, text_col, radius).select("doc_id", "fp", "component_id", "node"))
    keep = cut(found.where("doc_id = component_id").groupBy("node").agg(F.min("fp").alias("_fp"), F.first("doc_id").alias("_keep")).select("_keep", "_fp"))
    kept = docs.join(keep.select("_keep").distinct(), docs[id_col] == F.col("_keep"), "left_semi")
    again = cut(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")))
    nulls = docs.where(F.col(id_col).isNull())
    if again.isEmpty():
        return kept.unionByName(nulls)
    once = kept.join(again, kept[id_col] == again["_twice"], "left_anti")
    # only rows that share an id need their own fingerprint
    rest = kept.join(again, kept[id_col] == again["_twice"], "left_semi").withColumn("_own", F.pandas_udf(_simhash_series, "long")(F.col(text_col).cast("binary")))
    rest = rest.join(keep, (rest[id_col] == keep["_keep"]) & (rest["_own"] == keep["_fp"]), "left_semi").dropDuplicates([id_col, "_own"])
    return once.unionByName(rest.select(*docs.columns)).unionByName(nulls)


def op1_simhash(docs: DataFrame) -> DataFrame:
    """The query's columns: the fingerprint as 16 lower-case hex digits."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("n_near").cast("long").alias("n_near"), "component_id")
