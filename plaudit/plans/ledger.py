"""A ledger of stages: what was done with which inputs and parameters, and what is left to do.

Each stage has a folder of its own, named by a digest of its parameters, of the files it reads
(path, length, time of change) and of the stages before it.  Its rows are written first and its
manifest last, so a manifest means a whole result: a run that was killed goes on behind the last
manifest, and a changed input or parameter gives a new folder for the stage and all after it.
Nothing is built before it is asked for.  Tables that a stage stores on its way are its own and are
removed when it ends; ``clean`` removes results that no declared stage names any more.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove, scratch

_MANIFEST = "stage string, identity string, params string, reads string, after string, `rows` long"


class Ledger:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._stages: dict[str, tuple[Callable[[], DataFrame], list[str], list[str], dict]] = {}
        self._identities: dict[str, str] = {}

    def declare(
        self, name: str, build: Callable[[], DataFrame], after: Sequence[str] = (), reads: Sequence[str] = (), **params
    ) -> None:
        """A stage by name.  ``build`` may call ``frame`` of the stages in ``after``."""
        unknown = [a for a in after if a not in self._stages]
        if name in self._stages or unknown:
            raise ValueError(f"stage {name}: declared twice, or after undeclared {unknown}")
        self._stages[name] = (build, list(after), list(reads), params)

    def _listing(self, path: str) -> list[list[str]]:
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        stats = files.select("path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
        digest = stats.select(F.sha2(F.concat_ws("|", *stats.columns), 256).alias("h")).agg(
            F.count(F.lit(1)).cast("string"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)
        )
        return [list(r) for r in digest.collect()]  # one row, whatever the number of files

    def identity(self, name: str) -> str:
        if name not in self._identities:
            _, after, reads, params = self._stages[name]
            told = {
                "stage": name, "params": params, "reads": {p: self._listing(p) for p in reads},
                "after": {a: self.identity(a) for a in after},
            }
            self._identities[name] = hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:24]
        return self._identities[name]

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}/{self.identity(name)}"

    def _manifests(self, pattern: str) -> list:
        try:
            return self.spark.read.schema(_MANIFEST).json(pattern).collect()
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            return []

    def done(self, name: str) -> bool:
        return any(m["identity"] == self.identity(name) for m in self._manifests(f"{self._folder(name)}/manifest"))

    def frame(self, name: str) -> DataFrame:
        """The rows of a stage, built and written now unless its manifest is there."""
        build, after, reads, params = self._stages[name]
        folder = self._folder(name)
        if not self.done(name):
            with scratch(self.spark):
                build().write.mode("overwrite").parquet(f"{folder}/rows")
            rows = self.spark.read.parquet(f"{folder}/rows").count()
            told = (name, self.identity(name), json.dumps(params, sort_keys=True, default=str), json.dumps(reads), json.dumps(after), rows)
            self.spark.createDataFrame([told], _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
        return self.spark.read.parquet(f"{folder}/rows")

    def entries(self) -> list:
        """All manifests below the root, also of results that are out of date."""
        return self._manifests(f"{self.root}/*/*/manifest")

    def clean(self) -> list[str]:
        """Remove finished results that differ from the declared stages; returns their folders."""
        current = {self._folder(name) for name in self._stages}
        old = {f"{self.root}/{m['stage']}/{m['identity']}" for m in self.entries()} - current
        for folder in sorted(old):
            remove(self.spark, folder)
        return sorted(old)
