"""A forest that re-learns the segments, to show which features tell them apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, Window, functions as F

from ledgerscope.operators.keys import small_side
from ledgerscope.operators.sampling import sample_order, sample_rows
from ledgerscope.segmentation.prepare import ID, assemble
from ledgerscope.session import cut_lineage, new_folder, write_and_read
from ledgerscope.stats.rank_tests import classification_report

FIT_TASKS = 16  # fixed, so that the same seed grows the same forest on any cluster


@dataclass
class Surrogate:
    importance: DataFrame
    predictions: DataFrame
    report: DataFrame
    accuracy: float
    fitted_rows: int
    scored_rows: int


def stratified_split(rows: DataFrame, label: str, test_share: float, seed: int) -> DataFrame:
    """Add ``is_test``: per label, the rows with the smallest seeded hash. For bounded samples."""
    order = Window.partitionBy(label).orderBy(sample_order(ID, seed), ID)
    size = F.count(F.lit(1)).over(Window.partitionBy(label))
    return rows.withColumn("is_test", F.row_number().over(order) <= F.round(size * test_share))


def surrogate_importance(scaled: DataFrame, assignments: DataFrame, sample_size: int = 100_000, seed: int = 42,
                         trees: int = 250, depth: int = 14, min_leaf: int = 10) -> Surrogate:
    """Forest fitted on three quarters, by stratum, of at most ``sample_size`` rows, classes weighted to balance.

    It is scored on every row outside the fit.
    """
    labelled = scaled.join(assignments.select(ID, F.col("cluster").cast("double").alias("label")), ID)
    return surrogate_of(labelled, [c for c in scaled.columns if c != ID], sample_size, seed, trees, depth, min_leaf)


def surrogate_of(labelled: DataFrame, columns: list[str], sample_size: int = 100_000, seed: int = 42,
                 trees: int = 250, depth: int = 14, min_leaf: int = 10) -> Surrogate:
    """The same over rows that hold their ``label``."""
    spark = labelled.sparkSession
    sample = stratified_split(sample_rows(labelled, ID, sample_size, seed), "label", 0.25, seed + 1)
    # The split leaves one task per label; dealt by id, the forest is grown by many.
    sample = cut_lineage(assemble(sample, columns).repartition(FIT_TASKS, ID).sortWithinPartitions(ID))
    train = sample.where(~F.col("is_test"))
    per_class = train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sum(r["n"] for r in per_class)
    weight = F
    for r in per_class:
        weight = weight.when(F.col("label") == r["label"], rows / (len(per_class) * r["n"]))
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=seed, cacheNodeIds=True)
    # A freshly fitted forest carries its training summary, and with it the session, which cannot
    # travel to tasks once the session has observed a metric. The stored model has no summary.
    path = new_folder(spark, "forest")
    forest.fit(train.withColumn("weight", weight.otherwise(1.0))).write().save(path)
    model = RandomForestClassificationModel.load(path)
    rest = labelled.join(small_side(train.select(ID), rows), ID, "left_anti")
    predictions = write_and_read(model.transform(assemble(rest, columns)).select(ID, "label", "prediction"), new_folder(spark, "predictions"))
    importance = spark.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "feature string, importance double")
    report = classification_report(predictions)
    accuracy = report.where(F.col("entry") == "accuracy").first()
    return Surrogate(importance.orderBy(F.desc("importance"), "feature"), predictions, report,
                     accuracy["precision"] if accuracy else 0.0, rows, predictions.count())
