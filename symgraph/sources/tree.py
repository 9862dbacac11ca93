"""Source trees: a recursive walk, and reading with an error per file."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from symgraph.schema import FILES

#: The folder of a project's own store (see ``plans.tools.store_of``).
STORE_DIR = ".symgraph"
#: Entries of these names are left out; a tool's own folders can be added per call.
SKIPPED = frozenset({"node_modules", ".git", STORE_DIR})


def walk(root: str, skip: frozenset[str] = SKIPPED) -> list[str]:
    """Paths relative to ``root`` of files ending in .ts or .tsx, with slashes;
    links aren't followed, nor entries of the names in ``skip``."""
    out = []
    for at, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip and not os.path.islink(os.path.join(at, d)))
        for n in sorted(names):
            path = os.path.join(at, n)
            if n.endswith((".ts", ".tsx")) and n not in skip and os.path.isfile(path) and not os.path.islink(path):
                out.append(os.path.relpath(path, root).replace(os.sep, "/"))
    return out


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """``files(file, content, error)`` of ``paths(file)`` under a folder that all executors
    see, read by the workers; a file that can't be read has an error and no content,
    and no other fails with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["file"]:
                try:
                    with open(os.path.join(root, p), encoding="utf-8", newline="", errors="replace") as f:
                        rows.append((p, f.read(), None))
                except OSError as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["file", "content", "error"])

    return paths.select("file").mapInPandas(run, FILES)


def read_tree(spark: SparkSession, root: str, skip: frozenset[str] = SKIPPED) -> DataFrame:
    """The files of a tree (see ``read_files``), whose paths are listed here."""
    paths = walk(root, skip)
    df = spark.createDataFrame(pd.DataFrame({"file": pd.Series(paths, dtype=object)}), "file string")
    return read_files(df.repartition(max(1, min(len(paths) // 64 + 1, 10_000))), root)
