"""Distribution, rank tests and effect ranges of segments."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ledgerscope.functions.numbers import round_half_up
from ledgerscope.operators.ordering import with_running_total
from ledgerscope.schemas import require_columns

SIGNIFICANCE = 0.05


def cluster_distribution(assignments: DataFrame) -> DataFrame:
    require_columns(assignments.columns, ["cluster", "customer_id"], "Assignment table")
    sizes = assignments.groupBy("cluster").agg(F.count(F.lit(1)).alias("customer_count"))
    share = F.col("customer_count") / F.sum("customer_count").over(Window.partitionBy())
    return sizes.withColumn("customer_share", share).orderBy("cluster")


def _chi2_tail():
    """Upper tail of the chi-squared distribution for whole degrees of freedom (finite series).

    Returned as an inner function, so that it travels to the tasks by value.
    """
    def tail(statistic: float, freedom: int) -> float:
        half = max(statistic, 0.0) / 2
        even = freedom % 2 == 0
        total = math.exp(-half) if even else math.erfc(math.sqrt(half))
        power = 1.0 if even else 0.5
        term = math.exp(-half) * half ** power / math.gamma(power + 1)
        while power < freedom / 2:
            total += term
            power += 1
            term *= half / power
        return total

    return tail


chi2_tail = _chi2_tail()


# Values that agree to this many decimals are tied, so that sums made in another order cannot break ties.
TIE_DIGITS = 6


def kruskal_wallis(df: DataFrame, features: list[str], cluster: str = "cluster",
                   tie_digits: int | None = TIE_DIGITS) -> DataFrame:
    """Tie-corrected H and p-value per feature, smallest p first. Values are ranked at ``tie_digits`` decimals, or as they are (None).

    Rows are reduced to counts per (feature, value, cluster); a distributed
    running total over the distinct values gives mid-ranks, and one aggregation of these all sums. Features seen in
    fewer than two clusters are left out; a constant feature has no statistic.
    """
    require_columns(df.columns, [cluster], "Segmented table")
    present = [f for f in features if f in df.columns]
    value = lambda f: F.col(f).cast("double") if tie_digits is None else round_half_up(F.col(f), tie_digits)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), value(f).alias("v")) for f in present])
    long = df.select(F.col(cluster).alias("_cluster"), F.inline(pairs)).where(F.col("v").isNotNull())
    per_cluster = long.groupBy("feature", "v", "_cluster").agg(F.count(F.lit(1)).alias("n"))
    packed = per_cluster.groupBy("feature", "v").agg(
        F.sum("n").alias("ties"), F.map_from_entries(F.collect_list(F.struct("_cluster", "n"))).alias("by_cluster"))
    ranked = with_running_total(packed, "feature", F.col("v"), "ties", "upto")
    ranked = ranked.withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2.0)
    # A value shared by t rows adds t**3 - t to the tie correction; each of its rows carries t**2 - 1 of that.
    each = ranked.select("feature", "rank", (F.col("ties").cast("double") * F.col("ties") - 1).alias("tied"), F.explode("by_cluster").alias("_cluster", "n"))
    groups = each.groupBy("feature", "_cluster").agg(
        F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("n")).alias("rank_sum"), F.sum(F.col("tied") * F.col("n")).alias("tied"))
    both = groups.groupBy("feature").agg(
        F.count(F.lit(1)).alias("cluster_count"), F.sum("n").alias("total"), F.sum("tied").alias("tied"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("squares")).where(F.col("cluster_count") >= 2)
    size = F.col("total").cast("double")
    raw = F.lit(12.0) / (size * (size + 1)) * F.col("squares") - 3 * (size + 1)
    correction = 1 - F.col("tied") / (size * size * size - size)
    scored = both.withColumn("statistic", raw / F.nullif(correction, F.lit(0.0)))

    upper_tail = _chi2_tail()

    # One row per feature.
    @F.pandas_udf("double")
    def tail(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(h) else upper_tail(h, int(f)) for h, f in zip(statistic, freedom)],
                         dtype="float64")

    out = scored.withColumn("p_value", tail("statistic", (F.col("cluster_count") - 1).cast("int")))
    return out.select("feature", "cluster_count", F.lit("Kruskal-Wallis").alias("test"), "statistic", "p_value",
                      F.coalesce(F.col("p_value") < SIGNIFICANCE, F.lit(False)).alias("significant_at_0_05")
                      ).orderBy(F.asc_nulls_last("p_value"), "feature")


def effect_range(profile: DataFrame) -> DataFrame:
    """Smallest and largest cluster mean per feature, widest range first."""
    require_columns(profile.columns, ["cluster"], "Standardized profile")
    features = [c for c in profile.columns if c != "cluster"]
    one = profile.agg(*[F.min(c).alias(f"lo_{c}") for c in features], *[F.max(c).alias(f"hi_{c}") for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").cast("double").alias("minimum_cluster_mean"),
                              F.col(f"hi_{c}").cast("double").alias("maximum_cluster_mean")) for c in features])
    span = F.col("maximum_cluster_mean") - F.col("minimum_cluster_mean")
    return one.select(F.inline(rows)).withColumn("standardized_range", span).orderBy(
        F.desc("standardized_range"), "feature")


def classification_report(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages.

    Everything is derived from the confusion counts; an undefined ratio is 0.
    """
    confusion = predictions.groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("said")
                                    ).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col("actual") == F.col("said"), F.col("n")).otherwise(none)
    cells = confusion.select(F.inline(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), none.alias("said"), hit.alias("hits")),
        F.struct(F.col("said").alias("class"), none.alias("support"), F.col("n").alias("said"), none.alias("hits")),
    ))).groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hits").alias("hits"))
    ratio = lambda num, den: F.coalesce(F.col(num) / F.nullif(F.col(den), F.lit(0)), F.lit(0.0))
    scored = cells.withColumns({"precision": ratio("hits", "said"), "recall": ratio("hits", "support")})
    both = F.col("precision") + F.col("recall")
    scored = scored.withColumn("f1_score", F.coalesce(
        2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0)), F.lit(0.0)))
    measures = ["precision", "recall", "f1_score"]
    entry = lambda name, values, count: F.struct(
        name.alias("entry"), *[v.alias(m) for m, v in zip(measures, values)], count.alias("support"))
    support, right = F.sum("support"), F.sum("hits") / F.sum("support")
    averages = F.array(
        entry(F.lit("accuracy"), [right] * 3, support),
        entry(F.lit("macro avg"), [F.avg(m) for m in measures], support),
        entry(F.lit("weighted avg"), [F.sum(F.col(m) * F.col("support")) / support for m in measures], support))
    # One row per class, so the whole report fits one small aggregate.
    classes = F.collect_list(entry(F.col("class").cast("string"), [F.col(m) for m in measures], F.col("support")))
    return scored.agg(F.concat(classes, averages).alias("entries")).select(F.inline("entries"))
