"""Retrieval quality: recall, reciprocal ranks, nearest-rank percentiles, movement between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judge(cases: DataFrame, found: DataFrame, *, case: str, expected: str, rank: str = "rank", item: str = "row") -> DataFrame:
    """For each case: expected, satisfied, recall, first_hit (rank or null). cases: one row per expected item."""
    hits = cases.select(case, F.col(expected).alias("_e")).distinct().join(found.select(case, F.col(item).alias("_e"), F.col(rank).alias("_r")), [case, "_e"], "left")
    best = hits.groupBy(case, "_e").agg(F.min("_r").alias("_r"))
    out = best.groupBy(case).agg(F.count(F.lit(1)).alias("expected"), F.count("_r").alias("satisfied"), F.min("_r").alias("first_hit"))
    return out.withColumn("recall", F.col("satisfied") / F.col("expected"))


def report(judged: DataFrame, digits: int = 6) -> DataFrame:
    """One row: cases, recall_at_k, mrr_at_k, misses (cases without full recall)."""
    return judged.agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.avg("recall"), digits).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0))), digits).alias("mrr_at_k"), F.count_if(F.col("recall") < 1).alias("misses"),
    )


#: Ranges that nearest_rank() deals the values of a group to.
RANGES = 64


def nearest_rank(rows: DataFrame, value: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """Percentiles by nearest rank: the value at place round(share * (n - 1)), half to even, of the sorted values.

    Equal values are counted first. The rest is dealt to ranges whose bounds a sketch of each group estimates (they decide
    who counts what, never the result): ranks within a range come from a window over it, those before it from the ranges'
    totals, RANGES rows a group. So a group of any size is spread over many tasks."""
    each = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    bounds = each.groupBy(*by).agg(F.percentile_approx(value, [k / RANGES for k in range(1, RANGES)], 1000).alias("_b"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in by]
    both = each.alias("x").join(bounds.alias("y"), same) if by else each.alias("x").crossJoin(bounds.alias("y"))
    dealt = both.select("x.*", F.size(F.filter("_b", lambda b: b < F.col(f"x.{value}"))).alias("_r"))
    inside = Window.partitionBy(*by, "_r").orderBy(value)
    ranked = dealt.withColumn("_upto", F.sum("_c").over(inside))
    totals = dealt.groupBy(*by, "_r").agg(F.sum("_c").alias("_t"))
    group = Window.partitionBy(*by)
    totals = totals.withColumn("_n", F.sum("_t").over(group)).withColumn("_before", F.sum("_t").over(group.orderBy("_r")) - F.col("_t"))
    again = [F.col(f"x.{k}").eqNullSafe(F.col(f"z.{k}")) for k in [*by, "_r"]]
    placed = ranked.alias("x").join(totals.alias("z"), again).select("x.*", "_n", (F.col("_before") + F.col("_upto")).alias("_end"))
    at = lambda s: F.bround(F.lit(float(s)) * (F.col("_n") - 1)).cast("long")
    pick = lambda s: F.max(F.when((at(s) < F.col("_end")) & (at(s) >= F.col("_end") - F.col("_c")), F.col(value)))
    return placed.groupBy(*by).agg(*[pick(s).alias(k) for k, s in shares.items()], F.max(value).alias("max"), F.sum("_c").alias("n"))


def movement(before: Column, after: Column) -> Column:
    """Of two first-hit ranks: improved, regressed or unchanged; null is no hit."""
    return F.when(before.eqNullSafe(after), "unchanged").when(before.isNull(), "improved").when(after.isNull(), "regressed").when(after < before, "improved").otherwise("regressed")


def compare(old: DataFrame, new: DataFrame, case: str) -> DataFrame:
    """Cases of both runs with how they moved; cases of one run only drop out."""
    a, b = old.select(case, F.col("first_hit").alias("before")), new.select(case, F.col("first_hit").alias("after"))
    return a.join(b, case).withColumn("movement", movement(F.col("before"), F.col("after")))


def latest_comparable(runs: DataFrame, at: str, run: str, same: list[str]) -> DataFrame:
    """Each run with the newest strictly earlier one that is alike in `same`."""
    stamped = runs.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    w = Window.partitionBy(*same).orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    return stamped.withColumn("previous", F.last(F.struct("_t", run)).over(w)[run]).drop("_t")
