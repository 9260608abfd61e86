"""Global orders without one task for all rows: running sums and maxima, order statistics, numbers.

Rows are dealt into some hundred buckets by approximate quantiles of the key. Totals of the
buckets are so few that they meet in one place, and each bucket is ordered for itself. Equal
keys are in one bucket, so callers sum them first where one key can have very many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def bucketed(rows: DataFrame, key: str, name: str = "bucket") -> DataFrame:
    """`rows` with a bucket number that grows with the column `key`; null keys are in the first.
    The bounds are looked up at once, so that every use of the rows deals them alike."""
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = sorted(set(rows.agg(F.percentile_approx(key, shares, 2000)).first()[0] or []))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    return rows.withColumn(name, F.when(F.col(key).isNull(), 0).otherwise(place))


def running(rows: DataFrame, key: str, out: dict[str, tuple[str, Column]], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """`rows` with running aggregates in the order of `key`, the row itself included, of rows
    with equal `by`: out[name] = ("sum" or "max", value). Keys must differ within a `by`."""
    dealt = bucketed(rows.withColumns({f"_{n}": value for n, (_, value) in out.items()}), key, "_bucket")
    agg = {"sum": F.sum, "max": F.max}
    order = lambda c: F.desc(c) if descending else F.asc(c)
    totals = dealt.groupBy(*by, "_bucket").agg(*(agg[kind](f"_{n}").alias(f"_{n}") for n, (kind, _) in out.items()))
    before = Window.partitionBy(*by).orderBy(order("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_bucket", *(agg[kind](f"_{n}").over(before).alias(f"_before_{n}") for n, (kind, _) in out.items()))
    within = Window.partitionBy(*by, "_bucket").orderBy(order(key)).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({f"_{n}": agg[kind](f"_{n}").over(within) for n, (kind, _) in out.items()})
    joined = own.join(totals, [*by, "_bucket"])
    both = lambda n, kind: F.coalesce(F.col(f"_before_{n}") + F.col(f"_{n}") if kind == "sum" else F.greatest(f"_before_{n}", f"_{n}"), F.col(f"_{n}"), F.col(f"_before_{n}"))
    return joined.select(*rows.columns, *(both(n, kind).alias(n) for n, (kind, _) in out.items()))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """`rows` with `number`, their place from 0 in the order of (key, *order)."""
    dealt = bucketed(rows, key, "_bucket")
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))  # a row a bucket
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(key, *order))
    return dealt.withColumn("_own", own).join(F.broadcast(totals), "_bucket").select(*rows.columns, (F.col("_before") + F.col("_own") - 1).alias("number"))


def quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with `values`, the interpolated exact quantiles of a column; nulls don't count.
    Equal values are counted first; a value is looked up by the ranks that it holds."""
    counts = rows.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    wanted = rows.sparkSession.createDataFrame([(i, s) for i, s in enumerate(shares)], "i int, share double").crossJoin(F.broadcast(total))
    at = F.col("share") * (F.col("total") - 1)
    wanted = wanted.where("total > 0").select("i", F.floor(at).alias("low"), F.ceil(at).alias("high"), (at - F.floor(at)).alias("part"))
    held = running(counts, "v", {"upto": ("sum", F.col("n"))}).select("v", (F.col("upto") - F.col("n")).alias("before"), "upto")
    holds = lambda rank: (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
    found = held.join(F.broadcast(wanted), holds("low") | holds("high"))  # a row or two a share
    low, high = (F.max(F.when(holds(r), F.col("v"))) for r in ("low", "high"))
    value = found.groupBy("i").agg((low + F.max("part") * (high - low)).alias("value"))
    return value.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("values"))
