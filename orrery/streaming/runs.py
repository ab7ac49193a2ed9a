"""A folded table as runs: what a micro-batch writes follows the batch, not the table.

Each batch is folded by key and written as a run of its own.  When ``fan`` runs of a level are there, they become one of the next
level, so a row is written once a level (the logarithm of the table's batches), and a reader folds a few runs.  All of
an earlier run arrived before any of a later one, so folding runs in their order gives what folding all patches would.

A manifest a batch names the runs that are the table; it is written under another name and moved when it is whole.  A
batch that runs again after a failure starts from the manifest before it, so the last two are kept, and the runs that
neither names are deleted.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators import merge
from orrery.sources.shared import opened

FAN = 8


class RunTable:
    """``keys`` and ``rules`` are those of ``merge.fold``; new columns may appear with any batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], rules: dict[str, merge.Rule], fan: int = FAN):
        self.spark, self.path, self.keys, self.rules, self.fan = spark, path.rstrip("/"), keys, rules, fan
        self.where, self.folder = opened(self.path)
        for part in ("manifest", "runs"):
            self.where.create_dir(f"{self.folder}/{part}", recursive=True)

    def _versions(self) -> list[int]:
        names = [f.base_name for f in self.where.get_file_info(fs.FileSelector(f"{self.folder}/manifest"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def runs(self, below: int | None = None) -> list[dict]:
        """The runs of the last manifest (of one before ``below``), oldest first: name, level, first and last batch."""
        found = [v for v in self._versions() if below is None or v < below]
        if not found:
            return []
        with self.where.open_input_stream(f"{self.folder}/manifest/{found[-1]}.json") as stream:
            return json.loads(stream.read())

    def _folded(self, runs: list[dict]) -> DataFrame:
        every = None
        for k, run in enumerate(runs):
            rows = self.spark.read.parquet(f"{self.path}/runs/{run['name']}").withColumn("seq", F.lit(k))
            every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
        return merge.fold(every, self.keys, self.rules)

    def read(self, below: int | None = None) -> DataFrame | None:
        """The table, one row a key; None before the first batch."""
        runs = self.runs(below)
        return self._folded(runs) if runs else None

    def _write(self, rows: DataFrame, first: int, last: int, level: int) -> dict:
        name = f"{first:012d}-{last:012d}-{level}"
        rows.write.mode("overwrite").parquet(f"{self.path}/runs/{name}")
        return {"name": name, "level": level, "first": first, "last": last}

    def apply(self, batch: DataFrame, version: int) -> None:
        """Fold a batch of patches (with ``seq``) into the table as number ``version``."""
        runs = self.runs(below=version)
        runs.append(self._write(merge.fold(batch, self.keys, self.rules), version, version, 0))
        while len(tail := [r for r in runs[-self.fan :] if r["level"] == runs[-1]["level"]]) == self.fan:
            merged = self._write(self._folded(tail), tail[0]["first"], tail[-1]["last"], tail[0]["level"] + 1)
            runs[-self.fan :] = [merged]
        name = f"{self.folder}/manifest/{version}"
        with self.where.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps(runs).encode())
        if version in self._versions():
            self.where.delete_file(f"{name}.json")
        self.where.move(f"{name}.part", f"{name}.json")
        self._expire(version)

    def _expire(self, version: int) -> None:
        kept = [v for v in self._versions() if v <= version][-2:]
        named = {r["name"] for v in kept for r in self.runs(below=v + 1)}
        for f in self.where.get_file_info(fs.FileSelector(f"{self.folder}/runs")):
            if f.base_name not in named:
                self.where.delete_dir(f.path)
        for v in self._versions():
            if v not in kept:
                self.where.delete_file(f"{self.folder}/manifest/{v}.json")
