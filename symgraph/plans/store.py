"""The graph store: immutable snapshots of nodes, edges and file hashes."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import is_unresolved
from symgraph.operators import dml, graph
from symgraph.schema import EDGE_COLS, EDGES, FILE_HASHES, NODES, SCHEMA_VERSION


class GraphStore:
    """Snapshots ``v=<n>/{nodes,edges,file_hashes}`` under a folder, and a pointer
    that is replaced at once: readers see whole versions, and a failed step leaves
    the last one. A step reads version n and writes n+1."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.root.mkdir(parents=True, exist_ok=True)
        self.schema_version = SCHEMA_VERSION

    @property
    def version(self) -> int:
        p = self.root / "_CURRENT"
        return int(p.read_text()) if p.exists() else 0

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(str(self.root / f"v={self.version}" / name))

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes", NODES)

    @property
    def edges(self) -> DataFrame:
        return self._table("edges", EDGES)

    @property
    def file_hashes(self) -> DataFrame:
        return self._table("file_hashes", FILE_HASHES)

    def publish(self, nodes: DataFrame | None = None, edges: DataFrame | None = None, hashes: DataFrame | None = None) -> None:
        """Writes the next version; a table that isn't given stays. Edges are laid out
        by target, nodes and hashes by file, so that scans can skip row groups."""
        n = self.version + 1
        for name, df, by in (("nodes", nodes, "file"), ("edges", edges, "target"), ("file_hashes", hashes, "file")):
            df = getattr(self, name) if df is None else df
            df.repartitionByRange(by).sortWithinPartitions(by).write.mode("overwrite").parquet(str(self.root / f"v={n}" / name))
        tmp = self.root / "_CURRENT.tmp"
        tmp.write_text(str(n))
        os.replace(tmp, self.root / "_CURRENT")

    # reads
    def get_node(self, node_id: str):
        return self.nodes.where(F.col("id") == node_id).first()

    def find_nodes(self, name: str, file: str | None = None) -> DataFrame:
        """By name; an empty file counts as none. In order of file, line and id."""
        out = self.nodes.where(F.col("name") == name)
        return (out.where(F.col("file") == file) if file else out).orderBy("file", "start_line", "id")

    def nodes_by_file(self, file: str) -> DataFrame:
        return self.nodes.where(F.col("file") == file).orderBy("start_line", "id")

    def neighbors(self, node_id: str, direction: str = "both", kind: str | None = None) -> DataFrame:
        center = self.spark.createDataFrame([(node_id,)], "id string")
        return graph.neighbors(self.nodes, self.edges, center, direction, kind)

    def unresolved_edges(self) -> DataFrame:
        return self.edges.where(is_unresolved(F.col("target"))).orderBy("created_at", "source", "target")

    def edges_by_source(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("source") == node_id).orderBy("created_at", "target", "kind", "provenance_source")

    def file_hash(self, file: str) -> str | None:
        row = self.file_hashes.where(F.col("file") == file).first()
        return row.hash if row else None

    def list_files(self) -> list[str]:
        return [r.file for r in self.file_hashes.select("file").orderBy("file").collect()]

    # writes
    def add_nodes(self, rows: list[tuple]) -> None:
        new = dml.last_wins(self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], NODES + ", seq int"), ["seq"], ["id"])
        self.publish(nodes=dml.upsert_nodes(self.nodes, new))

    def add_edges(self, rows: list[tuple]) -> None:
        new = dml.last_wins(self.spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EDGES + ", seq int"), ["seq"])
        self.publish(edges=dml.upsert_edges(self.edges, new))

    def delete_edge(self, source: str, target: str, kind: str, provenance: str) -> None:
        key = self.spark.createDataFrame([(source, target, kind, provenance)], "source string, target string, kind string, provenance_source string")
        self.publish(edges=dml.delete_edges(self.edges, key).select(*EDGE_COLS))

    def delete_file(self, file: str) -> None:
        n, e, h = dml.delete_files(self.nodes, self.edges, self.file_hashes, self.spark.createDataFrame([(file,)], "file string"))
        self.publish(n, e, h)

    def set_file_hash(self, file: str, digest: str, now: int) -> None:
        new = self.spark.createDataFrame([(file, digest, now)], FILE_HASHES)
        self.publish(hashes=dml.upsert(self.file_hashes, new, ["file"], ["file", "hash", "indexed_at"]))

    def close(self) -> None:
        """Nothing is held open."""
