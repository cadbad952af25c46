"""Relational helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of a source, as its statistics have them, that go to one task.
STEP = 1 << 18
#: Parts into which keys are dealt for running sums.
PARTS = 64


def _part(key: Column, cuts: list[float]) -> Column:
    """How many of the cuts are not above the key; nulls are after all."""
    if not cuts:
        return F.lit(0)
    return F.when(key.isNull(), len(cuts)).otherwise(F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: key >= x)))


def running(rows: DataFrame, key: str, value: str, *by: str) -> DataFrame:
    """rows with `before`, the sum of a whole-numbered value over the rows of the group with a smaller key; keys are distinct in a group, and
    null is the largest. Numbers are dealt by their quantiles, so that no task has a whole group; groups are few. Other keys are one part."""
    kind = rows.schema[key].dataType.typeName()
    numeric = kind in ("byte", "short", "integer", "long", "float", "double") or kind.startswith("decimal")
    at = F.percentile_approx(F.col(key).cast("double"), [k / PARTS for k in range(1, PARTS)], 10_000)
    cuts = sorted({x for x in rows.agg(at).first()[0] or [] if x == x}) if numeric else []
    own = rows.withColumn("__part", _part(F.col(key).cast("double"), cuts))
    sums = own.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = earlier(Window.partitionBy(*by, F.lit(0)).orderBy("__part"))
    sums = sums.select(*by, "__part", F.coalesce(F.sum("__sum").over(parts), F.lit(0)).alias("__start"))
    within = earlier(Window.partitionBy(*by, "__part").orderBy(F.col(key).asc_nulls_last()))
    own = own.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(sums), [*by, "__part"])
    return own.select(*rows.columns, (F.col("__start") + F.col("__within")).alias("before"))


def dealt(rows: DataFrame, source: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """rows by keys, in a number of parts that grows with their source, a table or columns of it of which each row became `times`. Spark would join parts by their compressed
    bytes, and millions of rows of few distinct values are few bytes, but not few in a sort. Small sources are left to Spark, and those of
    unknown size, which statistics have as exabytes."""
    parts = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * times // STEP
    return rows.repartition(min(parts, 20_000), *keys) if rows.sparkSession.sparkContext.defaultParallelism < parts < times << 32 else rows


def top_k(rows: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group, with their rank; Spark limits groups before the shuffle too."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, other: str, seconds: int) -> DataFrame:
    """Rows of right at most `seconds` before a row of left: both meet in time buckets of that width, an equality join."""
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c)) / seconds)
    a = left.withColumn("__b", F.explode(F.array(bucket(at), bucket(at) - 1)))
    b = right.withColumn("__b", bucket(other))
    width = F.make_interval(secs=F.lit(seconds))
    return a.join(b, [key, "__b"]).where((F.col(other) <= F.col(at)) & (F.col(other) >= F.col(at) - width)).drop("__b")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """left with the value of the latest row of right at or before it: one union, one sort, no pairs."""
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__left", F.lit(1))
    both = both.unionByName(right.select(*[F.col(c) if c in (*by, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.col(value).alias("__v"), F.lit(0).alias("__left")))
    w = Window.partitionBy(*by).orderBy(at, "__left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("__v", ignorenulls=True).over(w)).where("__left = 1").drop("__v", "__left")
