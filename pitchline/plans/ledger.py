"""A table that grows by commits: each is a folder of Parquet files and an entry in a log of numbered files.

An entry is created in one step and only if no other has its number, so a reader sees a commit whole or not at all,
and of two writers that have read the same state one has to look again.  What a writer leaves without an entry is
no part of the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import files

#: Times a writer looks again because another one has committed meanwhile.
TRIES = 20


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def entries(self) -> list[dict]:
        """The commits so far, in order."""
        return [json.loads("".join(files.lines(self.spark, f))) for f in files.found(self.spark, f"{self.path}/_log/*.json")]

    def read(self) -> DataFrame | None:
        """All commits' rows, None before the first."""
        return self._of(self.entries())

    def _of(self, entries: list[dict]) -> DataFrame | None:
        folders = [f"{self.path}/{e['folder']}" for e in entries]
        return self.spark.read.option("mergeSchema", True).parquet(*folders) if folders else None

    def append(self, make: Callable[[DataFrame | None], DataFrame], batch: str | None = None) -> bool:
        """Commits the rows that ``make`` builds from the rows so far; whether it did.

        A ``batch`` that the log holds already isn't committed again.  If another writer commits first, the rows are
        built again from what is there then.
        """
        for _ in range(TRIES):
            entries = self.entries()
            if batch is not None and any(e["batch"] == batch for e in entries):
                return False
            folder = f"data/{uuid.uuid4().hex}"
            make(self._of(entries)).write.parquet(f"{self.path}/{folder}")
            if files.create(self.spark, f"{self.path}/_log/{len(entries):010d}.json", json.dumps({"folder": folder, "batch": batch})):
                return True
        raise RuntimeError(f"{self.path}: others committed {TRIES} times meanwhile")
