"""A kept index of keys: batches are checked for uniqueness without the old rows.

Keys are stored in runs, a run for each batch, parted in buckets by their hash and
sorted in them. A run of a tier waits until there are `TIER_RUNS` of it; then they are
merged into one of the next tier, so there are runs by the logarithm of the batches.
A batch reads only the buckets that its own keys are in, of each run, and only
keys. A key that goes is stored as gone until the oldest run is merged with it. The
list of runs is a manifest, committed like a version of a view.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.plans.store import Manifests

#: Runs of a tier that are merged into one of the next.
TIER_RUNS = 4
#: Parts that keys are dealt to by their hash.
BUCKETS = 256
RUNS = "runs array<struct<path: string, tier: int, seq: int>>"


@dataclass(frozen=True)
class Run:
    path: str
    tier: int
    seq: int


class KeyIndex:
    """The keys ``key (name, type)`` of a table, under ``path``. A key with a null
    clashes with nothing and is not kept."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[tuple[str, str]], buckets: int = BUCKETS):
        self.manifests, self.spark, self.path = Manifests(spark, path), spark, path.rstrip("/")
        self.key, self.kinds, self.buckets = [n for n, _ in key], dict(key), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def keys(self, df: DataFrame) -> DataFrame:
        there = reduce(Column.__and__, [F.col(k).isNotNull() for k in self.key])
        return df.select(*(F.col(k).cast(t).alias(k) for k, t in self.kinds.items())).where(there).withColumn("__bucket", self.bucket())

    def runs(self, number: int | None = None) -> tuple[int, list[Run]]:
        """The number of the last manifest, and the runs that it lists; or those of the
        last one up to ``number``."""
        held = [m for m in self.manifests.held(RUNS) if number is None or m["number"] <= number]
        last = max(self.manifests.numbers(), default=0)
        return last, [Run(**r) for r in held[-1]["runs"]] if held else []

    def read(self, run: Run) -> DataFrame:
        kinds = ", ".join(f"`{k}` {t}" for k, t in self.kinds.items())
        return self.spark.read.schema(f"{kinds}, __gone boolean, __bucket int").parquet(run.path).withColumn("__seq", F.lit(run.seq))

    def latest(self, runs: Sequence[Run], buckets: Sequence[int] | None = None) -> DataFrame:
        """``(*key, __bucket, __gone, __seq)`` as the last run that has a key tells it."""
        parts = [self.read(r) if buckets is None else self.read(r).where(F.col("__bucket").isin(list(buckets))) for r in runs]
        told = reduce(DataFrame.unionByName, parts)
        return told.groupBy(*self.key, "__bucket").agg(F.max_by("__gone", "__seq").alias("__gone"), F.max("__seq").alias("__seq"))

    def known(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """The distinct keys of ``batch`` that the index holds (or held as of a manifest). At most as many bucket
        numbers as there are buckets come to the driver, to leave the others unread."""
        _, runs = self.runs(number)
        asked = self.keys(batch).distinct()
        if not runs:
            return asked.select(*self.key).limit(0)
        touched = [r[0] for r in asked.select("__bucket").distinct().collect()]
        held = self.latest(runs, touched).where("NOT __gone")
        return asked.join(held.select(*self.key), self.key, "left_semi").select(*self.key)

    def clashes(self, batch: DataFrame) -> DataFrame:
        """``(*key, rows, reason)``: keys of ``batch`` that are ``known`` to the index, or
        else ``repeated`` within the batch."""
        own = self.keys(batch).groupBy(*self.key).agg(F.count("*").alias("rows"))
        marked = own.join(self.known(batch).withColumn("__known", F.lit(True)), self.key, "left")
        reason = F.when(F.col("__known"), "known").when(F.col("rows") > 1, "repeated")
        return marked.select(*self.key, "rows", reason.alias("reason")).where("reason IS NOT NULL")

    def add(self, batch: DataFrame) -> None:
        """Keep the keys of ``batch``. Another writer's commit meanwhile is an error
        (`store.CommitConflict`), and nothing is kept."""
        self.append(batch, False)

    def remove(self, batch: DataFrame) -> None:
        self.append(batch, True)

    def append(self, batch: DataFrame, gone: bool) -> None:
        last, runs = self.runs()
        seq = max((r.seq for r in runs), default=0) + 1
        made = self.write(self.keys(batch).distinct().withColumn("__gone", F.lit(gone)), 0, seq)
        self.manifests.put(last + 1, {"runs": [asdict(r) for r in self.merged([*runs, made])]})

    def write(self, keys: DataFrame, tier: int, seq: int) -> Run:
        """A file for each bucket."""
        path = f"{self.path}/run-{uuid.uuid4().hex}"
        keys.select(*self.key, "__gone", "__bucket").repartition("__bucket").sortWithinPartitions("__bucket", *self.key).write.partitionBy("__bucket").parquet(path)
        return Run(path, tier, seq)

    def merged(self, runs: list[Run]) -> list[Run]:
        tier = 0
        while len(own := [r for r in runs if r.tier == tier]) >= TIER_RUNS:
            told = self.latest(own)
            if len(own) == len(runs):  # nothing older that a gone key would have to hide
                told = told.where("NOT __gone")
            runs = [*(r for r in runs if r.tier != tier), self.write(told, tier + 1, max(r.seq for r in own))]
            tier += 1
        return runs
