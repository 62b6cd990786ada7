"""Version resolution: the latest row of an id, all its versions, its row at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _best(rows: DataFrame, key: list[str], order: Column, biggest: bool) -> DataFrame:
    """One row for each key by an aggregate, which shrinks the rows before the shuffle; a window would sort them all after it."""
    pick = F.max_by if biggest else F.min_by
    best = rows.groupBy(*key).agg(pick(F.struct(*rows.columns), order).alias("g_row"))
    return best.select("g_row.*")


def latest(rows: DataFrame, key: str | list[str] = "id", time: str = "effectiveTime", arrival: str = "arrival") -> DataFrame:
    """The row of the greatest time for each key; of rows of equal time the one that arrived first."""
    keys = [key] if isinstance(key, str) else key
    return _best(rows, keys, F.struct(F.col(time), -F.col(arrival)), True)


def history(rows: DataFrame, ids: int | list[int], key: str = "id", time: str = "effectiveTime", arrival: str = "arrival") -> DataFrame:
    """All versions of the given ids, oldest first, in order of arrival where times are equal."""
    return rows.filter(F.col(key).isin(ids)).orderBy(key, time, arrival)


def as_of(rows: DataFrame, at: int | Column, key: str | list[str] = "id", time: str = "effectiveTime", arrival: str = "arrival") -> DataFrame:
    """The row of the greatest time up to `at` for each key; of rows of equal time the one that arrived last."""
    keys = [key] if isinstance(key, str) else key
    return _best(rows.filter(F.col(time) <= at), keys, F.struct(F.col(time), F.col(arrival)), True)


def as_of_join(probes: DataFrame, rows: DataFrame, key: str = "id", at: str = "at", time: str = "effectiveTime", arrival: str = "arrival") -> DataFrame:
    """For each probe (key, at), the version that held then; probes without one are kept with nulls.

    Probes and versions are laid in one sorted run for each key and the last version is carried
    forward: no pair of probe and version is made, so a key with many of both costs a sort only.
    """
    from pyspark.sql import Window

    value = F.struct(*rows.columns)
    both = probes.select(F.col(key).alias("g_key"), F.col(at).alias("g_time"), F.lit(None).cast(rows.schema[arrival].dataType).alias("g_arrival"), F.lit(1).alias("g_side"), F.struct(*probes.columns).alias("g_probe"), F.lit(None).cast(rows.select(value.alias("v")).schema["v"].dataType).alias("g_row")).unionByName(
        rows.select(F.col(key).alias("g_key"), F.col(time).alias("g_time"), F.col(arrival).alias("g_arrival"), F.lit(0).alias("g_side"), F.lit(None).cast(probes.select(F.struct(*probes.columns).alias("v")).schema["v"].dataType).alias("g_probe"), value.alias("g_row"))
    )
    w = Window.partitionBy("g_key").orderBy("g_time", "g_side", "g_arrival").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("g_row", F.last("g_row", ignorenulls=True).over(w)).filter("g_side = 1")
    extra = [c for c in rows.columns if c not in probes.columns]
    return carried.select("g_probe.*", *[F.col(f"g_row.{c}").alias(c) for c in extra])
