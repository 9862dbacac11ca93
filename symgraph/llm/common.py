"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``), also set as
    Spark's checkpoint folder. Unset on a local master, as in tests: a temporary
    folder. Unset on a cluster: an error, since a machine-local folder would
    lose data with its machine."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None and have.isDefined():
        return have.get()
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="symgraph-")
        spark.conf.set("spark.checkpoint.dir", where)
    if not have.isDefined():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder; lost
    executors cost nothing, and Spark's cleaner drops the files with the plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, whatever case counts."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of the undirected graph of ``edges(a, b)``: rows ``(node,
    component)``, the component being its smallest node, for every node that has
    an edge to another node. Null ends and self-loops are ignored.

    Alternates the large-star and small-star contractions, which need a
    logarithmic number of rounds also on long chains. Hubs: the minimum of a
    neighbourhood is pre-aggregated, and the join that distributes it has one row
    per node on the right, so adaptive execution may split a hub's rows.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    before = None
    while True:
        signature = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if signature == before or signature[0] == 0:
            break
        before = signature
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


#: Bytes of a slice of an Arrow batch that a worker takes as Python objects at once.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES, one row at least; empty ones too."""
    for b in batches:
        rows = max(1, b.num_rows * SLICE_BYTES // max(b.nbytes, 1))
        for at in range(0, max(b.num_rows, 1), rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Returns freed memory to the system, so that an idle worker stays small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


#: Bytes of a batch between Spark and its workers, where the session has Spark's default of 64 MB.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with bounded slices, and memory given back after each task. Sets
    the session's bytes of a batch to BATCH_BYTES where they are at the default:
    each of the tasks of an executor holds some batches on both sides."""
    if df.sparkSession.conf.get(_BATCH, None) == f"{64 << 20}b":
        df.sparkSession.conf.set(_BATCH, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(slices(batches))
        finally:
            give_back()

    return df.mapInArrow(run, schema)


#: Cells of a filter of hashes (16 MB), and of the parts it is made in.
FILTER_CELLS, RANGE_CELLS = 1 << 27, 1 << 20


def _filter_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bitmap for each range of cells, from rows (range, h) sorted by range."""

    def close() -> pa.RecordBatch:
        bits = np.packbits(mark, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([bits], pa.binary())], names=["range", "bits"])

    at, mark = None, np.zeros(RANGE_CELLS, bool)
    for b in batches:
        ranges, h = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for r in np.unique(ranges):
            if r != at:
                if at is not None:
                    yield close()
                at, mark = int(r), np.zeros(RANGE_CELLS, bool)
            mark[(h[ranges == r] & np.uint64(RANGE_CELLS - 1)).astype(np.int64)] = True
    if at is not None:
        yield close()


class Filter:
    """A broadcast bit per cell of a set of hashes (16 MB, whatever their number).
    It lets other hashes through, so a join has to follow; where it fills up, that
    costs shuffle, not results."""

    def __init__(self, bits):
        self.bits = bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes (unsigned) may be in the set."""
        cell = (h & np.uint64(FILTER_CELLS - 1)).astype(np.int64)
        return (np.frombuffer(self.bits.value, np.uint8)[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


#: Drops the shuffle files of a query when it ends, where Spark's cleaner waits for a collection of the driver's garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_filter(hashes: DataFrame) -> Filter:
    """The filter of the hashes in ``hashes(h)``. What was shuffled for it goes from the
    disks once it is made, so ``hashes`` should hold no shuffle that is used again."""
    spark = hashes.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return _shared_filter(hashes)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def _shared_filter(hashes: DataFrame) -> Filter:
    cell = F.col("h").bitwiseAND(F.lit(FILTER_CELLS - 1))
    ranged = hashes.select(F.floor(cell / RANGE_CELLS).cast("int").alias("range"), "h").repartition("range").sortWithinPartitions("range")
    bits = np.zeros(FILTER_CELLS // 8, np.uint8)
    for r in ranged.transform(arrow, _filter_batches, "range int, bits binary").collect():
        bits[r["range"] * RANGE_CELLS // 8 : (r["range"] + 1) * RANGE_CELLS // 8] = np.frombuffer(bytes(r.bits), np.uint8)
    return Filter(hashes.sparkSession.sparkContext.broadcast(bits.tobytes()))
