"""Range-partitioned writing: expected and observed ranges, routing over a history of bounds, manifests."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inside(key: Column, low, high) -> Column:
    """``low <= key < high``; an unset bound (null) holds nothing."""
    return F.coalesce((key >= low) & (key < high), F.lit(False))


def observed(df: DataFrame, key: str, low, high, by: list[str] | None = None) -> DataFrame:
    """(by, smallest, largest, n, oob) of keys against the expected range."""
    k = F.col(key)
    return df.groupBy(*(by or [])).agg(F.min(k).alias("smallest"), F.max(k).alias("largest"), F.count(k).alias("n"), F.count_if(k.isNotNull() & ~inside(k, low, high)).alias("oob"))


def merged(states: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Observed ranges put together: (by, rmin, rmax, smallest, largest, n, oob); the bounds where ``states`` have them."""
    bounds = [f(c).alias(c) for f, c in ((F.min, "rmin"), (F.max, "rmax")) if c in states.columns]
    return states.groupBy(*(by or [])).agg(*bounds, F.min("smallest").alias("smallest"), F.max("largest").alias("largest"), F.sum("n").alias("n"), F.sum("oob").alias("oob"))


@dataclass(frozen=True)
class Bounds:
    """The active ranges: ``parts`` of the current one, then previous ones, the oldest last. Unset ranges are None."""

    parts: int = 1
    previous: int = 2
    ranges: tuple[tuple[float, float] | None, ...] = ()
    updates: int = 0

    def __post_init__(self):
        if self.parts < 1 or self.previous < 1:
            raise ValueError("at least one current and one previous range")
        if not self.ranges:
            object.__setattr__(self, "ranges", (None,) * (self.parts + self.previous))

    def updated(self, low: float, high: float) -> Bounds:
        """New bounds: the current range becomes the latest previous one, the oldest is forgotten."""
        if not low <= high:
            raise ValueError("bounds are in the wrong order")
        now, before = self.ranges[: self.parts], self.ranges[self.parts :]
        whole = (now[0][0], now[-1][1]) if now[0] is not None else None
        step = (high - low) / self.parts
        fresh = tuple((low + i * step, high if i == self.parts - 1 else low + (i + 1) * step) for i in range(self.parts))
        return Bounds(self.parts, self.previous, (*fresh, whole, *before[:-1]), self.updates + 1)

    def to_text(self) -> str:
        return json.dumps({"parts": self.parts, "previous": self.previous, "ranges": self.ranges, "updates": self.updates})

    @classmethod
    def from_text(cls, text: str) -> Bounds:
        raw = json.loads(text)
        return cls(raw["parts"], raw["previous"], tuple(None if r is None else tuple(r) for r in raw["ranges"]), raw["updates"])

    def route(self, key: Column) -> Column:
        """Number of the first active range that holds ``key``, else of the oldest one."""
        out = F.lit(len(self.ranges) - 1)
        for i in range(len(self.ranges) - 1, -1, -1):
            if self.ranges[i] is not None:
                out = F.when(inside(key, F.lit(self.ranges[i][0]), F.lit(self.ranges[i][1])), F.lit(i)).otherwise(out)
        return out

    def low(self, block: Column) -> Column:
        return F.get(F.array(*(F.lit(None if r is None else float(r[0])).cast("double") for r in self.ranges)), block)

    def high(self, block: Column) -> Column:
        return F.get(F.array(*(F.lit(None if r is None else float(r[1])).cast("double") for r in self.ranges)), block)


def routed(df: DataFrame, key: str, bounds: Bounds) -> DataFrame:
    """``df`` with blk, rmin, rmax, updcnt and oob."""
    k = F.col(key)
    out = df.withColumn("blk", bounds.route(k))
    out = out.withColumns({"rmin": bounds.low(F.col("blk")), "rmax": bounds.high(F.col("blk")), "updcnt": F.lit(bounds.updates)})
    return out.withColumn("oob", ~inside(k, F.col("rmin"), F.col("rmax")))


def route_by_history(df: DataFrame, history: DataFrame, key: str, epoch: str = "epoch") -> DataFrame:
    """``df`` with blk: 0 for the range of its epoch, 1 for the one before, 2 for the oldest or none.

    ``history`` has (epoch, low1, high1, low2, high2), a row for each epoch.
    """
    k = F.col(key)
    blk = F.when(inside(k, F.col("low1"), F.col("high1")), 0).when(inside(k, F.col("low2"), F.col("high2")), 1).otherwise(2)
    return df.join(history, epoch, "left").withColumn("blk", blk).drop("low1", "high1", "low2", "high2")


def manifest(rows: DataFrame, key: str = "fkey") -> DataFrame:
    """(epoch, updcnt, blk, rmin, rmax, smallest, largest, n, oob): a row for each block written."""
    return rows.groupBy("epoch", "updcnt", "blk").agg(F.min("rmin").alias("rmin"), F.min("rmax").alias("rmax"), F.min(key).alias("smallest"), F.max(key).alias("largest"), F.count("*").alias("n"), F.count_if("oob").alias("oob"))


class RangeTable:
    """A write-only table of float keys in range-ordered files. There is no point read.

    ``rows/batch=B`` holds what one ``add`` wrote, ``manifest/batch=B`` a row for each of its blocks, ``bounds/batch=B`` the bounds
    once it was written and after any update since. A batch that is added again overwrites its own files and is routed by the
    bounds it was routed by before, so that a restart changes nothing. Opening a path again goes on with the bounds left there.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 1, previous: int = 2, skip_sort: bool = False):
        self.spark, self.path, self.skip_sort = spark, path, skip_sort
        self.batch = -1
        stored = self._stored()
        self.initial = Bounds(parts, previous) if -1 not in stored else stored[-1]
        self.bounds = stored[max(stored)] if stored else self.initial
        self.batch = max(stored, default=-1)

    def _stored(self) -> dict[int, Bounds]:
        """Bounds by batch; a row for each batch is read, the latest of them is needed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bounds")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return {}
        rows = self.spark.read.schema("value string, batch int").text(f"{self.path}/bounds").collect()
        return {r["batch"]: Bounds.from_text(r["value"]) for r in rows}

    def _store(self) -> None:
        self.spark.range(1).select(F.lit(self.bounds.to_text()).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/bounds/batch={self.batch}")

    def update_bounds(self, low: float, high: float) -> None:
        self.bounds = self.bounds.updated(low, high)
        self._store()

    def add(self, df: DataFrame, epoch: int, key: str = "fkey", batch: int | None = None) -> None:
        """Write rows by the bounds of the moment; with ``batch`` by those that the batch before left."""
        if batch is None:
            self.batch += 1
        else:
            stored = self._stored() if batch <= self.batch else {}
            self.bounds = stored.get(batch - 1, self.initial) if stored else self.bounds
            self.batch = batch
        rows = routed(df.withColumn("epoch", F.lit(epoch)), key, self.bounds)
        dealt = rows.repartitionByRange("blk", key)
        dealt = dealt if self.skip_sort else dealt.sortWithinPartitions("blk", key)
        dealt.write.mode("overwrite").partitionBy("blk").parquet(f"{self.path}/rows/batch={self.batch}")
        back = self.spark.read.parquet(f"{self.path}/rows/batch={self.batch}")
        manifest(back, key).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={self.batch}")
        self._store()

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def manifest(self) -> DataFrame:
        """(batch, epoch, updcnt, blk, rmin, rmax, smallest, largest, n, oob), as written with the rows."""
        return self.spark.read.parquet(f"{self.path}/manifest")
