"""Versioned tables, backups, and the benchmark snapshot, on any Hadoop file system."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BACKUPS_KEPT = 3
GONE = "_gone"


class Folder:
    """Thin view of one folder through Spark's own Hadoop file-system client."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}" if name else self.path))

    def names(self) -> list[str]:
        if not self.exists():
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.path}/{name}")).getLength()

    def mark(self, name: str) -> None:
        self._fs.mkdirs(self._path(f"{self.path}/{name}"))

    def drop(self, name: str = "") -> None:
        self._fs.delete(self._path(f"{self.path}/{name}" if name else self.path), True)


class Table:
    """A table kept as full versions plus the change sets written since the last one.

    ``v=N`` holds all rows, ``c=N`` only rows that were added, replaced or deleted in step N. So
    a small update of a huge table writes little; ``fold`` merges the change sets into the next
    full version. A step counts once its success marker exists, so a reader never sees a
    half-written one, and nothing is overwritten while it is being read.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id") -> None:
        self.spark, self.key = spark, key
        self.folder = Folder(spark, path)

    def steps(self) -> list[str]:
        """Complete steps, oldest first."""
        names = [n for n in self.folder.names() if n[:2] in ("v=", "c=") and self.folder.exists(f"{n}/_SUCCESS")]
        return sorted(names, key=_step)

    def _next(self, kind: str) -> str:
        taken = [_step(n) for n in self.folder.names() if n[:2] in ("v=", "c=")]
        return f"{kind}={max(taken, default=0) + 1:08d}"

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/{name}")

    def pending_changes(self) -> list[str]:
        """Change sets since the last full version."""
        steps = self.steps()
        last = max((i for i, n in enumerate(steps) if n[0] == "v"), default=-1)
        return steps[last + 1 :]

    def read(self, step: int | None = None) -> DataFrame:
        """The rows as of a step, the latest by default."""
        steps = [n for n in self.steps() if step is None or _step(n) <= step]
        full = [i for i, n in enumerate(steps) if n[0] == "v"]
        if not full:
            raise FileNotFoundError(f"no version of {self.folder.path}")
        base, changes = self._load(steps[full[-1]]), steps[full[-1] + 1 :]
        if not changes:
            return base
        latest = self._latest(changes)
        kept = base.join(latest.select(self.key), self.key, "left_anti")
        return kept.unionByName(latest.filter(~F.col(GONE)).drop(GONE), allowMissingColumns=True)

    def _latest(self, names: list[str]) -> DataFrame:
        """The last change per key."""
        sets = [self._load(n).withColumn("_step", F.lit(_step(n))) for n in names]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
        if len(sets) == 1:
            return rows.drop("_step")
        values = [c for c in rows.columns if c not in (self.key, "_step")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*values), "_step").alias("_row"))
        return last.select(self.key, "_row.*")

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """Write a full version and return its step number."""
        name = self._next("v")
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.folder.path}/{name}")
        return _step(name)

    def write_changes(self, rows: DataFrame) -> int:
        """Add or replace rows, whole rows with unique keys. Returns how many there were."""
        return self._write_set(rows.withColumn(GONE, F.lit(False)))

    def delete(self, keys: DataFrame) -> int:
        """Delete the rows of a table of keys that exist. Returns how many there were."""
        wanted = keys.select(self.key).distinct()
        return self._write_set(self.read().join(wanted, self.key, "left_semi").withColumn(GONE, F.lit(True)))

    def _write_set(self, rows: DataFrame) -> int:
        name = self._next("c")
        rows.write.mode("errorifexists").parquet(f"{self.folder.path}/{name}")
        return self._load(name).count()

    def fold(self) -> int:
        """Write everything as one full version; the largest key ever used stays on record."""
        self.folder.mark(f"high={self.high_water()}")
        return self.write(self.read())

    def high_water(self) -> int:
        """The largest key ever used, deleted rows included."""
        known = [int(n[5:]) for n in self.folder.names() if n.startswith("high=")]
        steps = self.steps()
        base = [n for n in steps if n[0] == "v"][-1:]
        tops = [self._load(n).agg(F.max(self.key)).first()[0] for n in base + self.pending_changes()]
        return max([*known, *[t for t in tops if t is not None], 0])

    def prune(self, keep: int) -> None:
        """Drop all steps before the ``keep`` newest full versions."""
        steps = self.steps()
        full = [i for i, n in enumerate(steps) if n[0] == "v"]
        if len(full) > keep:
            for name in steps[: full[-keep]]:
                self.folder.drop(name)


def _step(name: str) -> int:
    return int(name[2:])


def backup(urls: DataFrame, path: str, stamp: str, reason: str = "manual", keep: int = BACKUPS_KEPT) -> str:
    """Write a named backup of a table and keep the newest ``keep``; ``stamp`` is YYYYMMDD-HHMMSS."""
    label = re.sub(r"[^a-zA-Z0-9_-]", "", reason)[:20] or "backup"
    name = f"urls-{stamp}-{label}"
    folder = Folder(urls.sparkSession, path)
    urls.write.mode("errorifexists").parquet(f"{folder.path}/{name}")
    for old in [n for n in folder.names() if n.startswith("urls-")][:-keep]:
        folder.drop(old)
    return name


def backups(spark: SparkSession, path: str) -> list[dict]:
    """Backups, newest first. The stamp in the name gives the order."""
    folder = Folder(spark, path)
    names = [n for n in folder.names() if n.startswith("urls-")]
    return [{"name": n, "size": folder.size(n)} for n in reversed(names)]


def take_snapshot(rows: DataFrame, path: str) -> DataFrame:
    """Write the benchmark snapshot; refuses to replace one, or to write an empty one."""
    folder = Folder(rows.sparkSession, path)
    if folder.exists():
        raise ValueError("a snapshot exists that was not restored")
    if rows.isEmpty():
        raise ValueError("no rows fit for a benchmark")
    rows.write.mode("errorifexists").parquet(folder.path)
    return rows.sparkSession.read.parquet(folder.path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if Folder(spark, path).exists("_SUCCESS") else None


def drop_snapshot(spark: SparkSession, path: str) -> None:
    """Remove the snapshot once the restored table has been written."""
    Folder(spark, path).drop()
