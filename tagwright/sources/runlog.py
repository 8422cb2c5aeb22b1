"""A committed log of split results: which run's rows count for which pair of candidate and split.

Every writer puts its rows into a folder of its own, ``runs/<name>``, and then claims its pairs in one numbered manifest,
``log/<number>.json``. A manifest is written under another name and renamed to the next free number; the rename fails if
that number exists. The writer that lost reads the new manifests, gives up the pairs that others have claimed meanwhile
and tries the next number. So a pair belongs to exactly one run, whoever writes at the same time, and a writer that dies
before its rename has finished nothing: its folder is never read. What is pending follows from the log alone.

The rename must be atomic and must not overwrite, as it is on HDFS; on a local disk a hard link does the same.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Pair = tuple[int, int]
PAIRS = "candidate int, split int"


class RunLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}")

    def manifests(self) -> list[dict]:
        """The manifests in the order of their numbers. They have a line per run; the rows stay where they are."""
        root = self._path("log")
        fs = root.getFileSystem(self._conf)
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().endswith(".json"))
        names = [n for n in names if not n.startswith((".", "_"))]
        if not names:
            return []
        read = self.spark.read.text([f"{self.folder}/log/{n}" for n in names], wholetext=True)
        return sorted((json.loads(r["value"]) for r in read.collect()), key=lambda m: m["number"])

    def owners(self) -> dict[Pair, str]:
        """The run that each finished pair belongs to."""
        found: dict[Pair, str] = {}
        for m in self.manifests():
            for pair in m["pairs"]:
                found.setdefault(tuple(pair), m["run"])
        return found

    def write(self, run: str, table: DataFrame) -> None:
        """Rows of a run, with columns ``candidate`` and ``split``; nobody reads them before they are committed."""
        (
            table.hint("rebalance", "candidate", "split").write.mode("append").partitionBy("candidate", "split")
            .parquet(f"{self.folder}/runs/{run}")
        )

    @staticmethod
    def new_run() -> str:
        return uuid.uuid4().hex

    def _claim(self, number: int, text: str) -> bool:
        """Write a manifest under a number that nobody has; false if somebody has."""
        fs = self._path("log").getFileSystem(self._conf)
        draft, final = self._path(f"log/.{uuid.uuid4().hex}.tmp"), self._path(f"log/{number:08d}.json")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if fs.getUri().getScheme() == "file":  # a local rename may overwrite; a hard link never does
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(draft, False)
        context, kind = self._hadoop.FileContext.getFileContext(fs.getUri(), self._conf), self._hadoop.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE  # do not overwrite
        try:
            context.rename(draft, final, options)
            return True
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)):
                return False
            raise

    def commit(self, run: str, pairs: list[Pair]) -> list[Pair]:
        """Claim the pairs for a run; returns those that are its own now."""
        while True:
            known = self.manifests()
            taken = {tuple(p) for m in known for p in m["pairs"]}
            own = sorted(set(pairs) - taken)
            if not own:
                return []
            number = max((m["number"] for m in known), default=-1) + 1
            if self._claim(number, json.dumps({"number": number, "run": run, "pairs": own})):
                return own

    def finished(self) -> DataFrame | None:
        """``candidate, split`` of the finished pairs, or None before the first."""
        pairs = sorted(self.owners())
        return self.spark.createDataFrame(pairs, PAIRS) if pairs else None

    def results(self) -> DataFrame | None:
        """The rows of all finished pairs, each from the run that owns it. A pair may have no row."""
        by_run: dict[str, dict[int, list[int]]] = {}
        for (candidate, split), run in sorted(self.owners().items()):
            by_run.setdefault(run, {}).setdefault(candidate, []).append(split)
        out = None
        for run, pairs in sorted(by_run.items()):
            path = self._path(f"runs/{run}")
            if not path.getFileSystem(self._conf).exists(path):
                continue  # a run without a row
            own = F.lit(False)
            for candidate, splits in pairs.items():
                own |= (F.col("candidate") == candidate) & F.col("split").isin(splits)  # columns of the folder names
            rows = self.spark.read.parquet(f"{self.folder}/runs/{run}").where(own)
            out = rows if out is None else out.unionByName(rows)
        return out
