"""Incremental indexing of a stream of file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symgraph.plans.index import index_files
from symgraph.plans.store import GraphStore


def index_stream(store: GraphStore, changes: DataFrame, checkpoint: str, now: int = 0, **options) -> StreamingQuery:
    """Indexes a stream of ``(file, content, error)`` rows by micro-batches: each row
    is the whole new text of a file; one row per file and batch counts (the largest
    text). Files that a batch doesn't name stay. A batch that is replayed finds its
    hashes stored and is skipped, so the result is the same."""

    def step(batch: DataFrame, _: int) -> None:
        one = batch.groupBy("file").agg(F.max(F.struct("content", "error")).alias("r")).select("file", "r.content", "r.error")
        known = store.file_hashes.join(one.select("file"), "file", "left_anti")
        kept = known.select("file", F.lit(None).cast("string").alias("content"), F.lit("unchanged").alias("error"))
        index_files(store, one.unionByName(kept), now, **options)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
