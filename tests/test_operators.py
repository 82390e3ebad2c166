from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from ledgerscope.operators import frequency, keys, ordering, quantiles, sampling


@pytest.fixture(scope="module")
def skewed(spark):
    """5,000 rows; one group holds a third, one value a third of that group; some nulls."""
    rng = np.random.default_rng(3)
    group = np.where(rng.random(5000) < 0.34, 0, rng.integers(1, 30, 5000))
    value = np.round(rng.lognormal(4, 2, 5000), 4) * np.where(rng.random(5000) < 0.2, -1, 1)
    value = np.where((group == 0) & (rng.random(5000) < 0.33), 7.25, value)
    tight = 1.0 + rng.integers(0, 50, 5000) * 1e-9
    frame = pd.DataFrame({"id": [f"r{i:05d}" for i in range(5000)], "g": group, "v": value, "w": tight})
    frame.loc[::17, "v"] = np.nan
    df = spark.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(6)
    return df.cache(), frame


@pytest.mark.parametrize("small", [1_000_000, 40, 1])
def test_group_quantiles_are_exact(skewed, small):
    df, frame = skewed
    probs = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    got = quantiles.group_quantiles(df, ["g"], ["v", "w"], probs, small_bucket=small).toPandas()
    assert len(got) == frame["g"].nunique() * 2 * len(probs)
    for r in got.itertuples():
        want = frame.loc[frame["g"] == r.g, r.measure].quantile(r.prob)
        assert r.value == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_column_quantiles_skip_empty_measures(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    assert quantiles.column_quantiles(df, ["a", "b"], [0.5]) == {"a": {0.5: 2.0}, "b": {}}


@pytest.mark.parametrize("buckets", [3, 10, 7000])
def test_global_ntile_equals_the_window_function(skewed, buckets):
    df, _ = skewed
    order = [F.col("v").asc_nulls_first(), F.col("id")]
    mine = ordering.global_ntile(df, order, buckets, "tile").select("id", "tile")
    want = df.select("id", F.ntile(buckets).over(Window.orderBy(*order)).cast("bigint").alias("tile"))
    assert mine.count() == 5000 and mine.exceptAll(want).isEmpty()


def test_row_number_and_total(skewed):
    df, _ = skewed
    got = ordering.with_row_number(df, [F.col("id")], "n", "total").select("id", "n", "total").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 5001)) and [r["id"] for r in got] == sorted(r["id"] for r in got)
    assert {r["total"] for r in got} == {5000}


def test_running_total_per_group(skewed):
    df, frame = skewed
    counts = df.where("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = ordering.with_running_total(counts, "g", F.col("v"), "n", "upto").toPandas().sort_values(["g", "v"])
    want = got.groupby("g")["n"].cumsum()
    assert (got["upto"] == want).all() and len(got) == counts.count()


def test_sample_is_reproducible_and_exact(skewed):
    df, frame = skewed
    first = {r["id"] for r in sampling.sample_rows(df, "id", 200).collect()}
    again = {r["id"] for r in sampling.sample_rows(df.repartition(3), "id", 200).collect()}
    top = df.orderBy(sampling.sample_order("id", 42), "id").limit(200)
    assert first == again == {r["id"] for r in top.collect()} and len(first) == 200
    assert {r["id"] for r in sampling.sample_rows(df, "id", 200, seed=7).collect()} != first
    assert sampling.sample_rows(df, "id", 9999).count() == 5000
    assert sampling.sample_rows(df, "id", 1).count() == 2  # at least two rows


def test_primary_value_and_first_row(spark):
    df = spark.createDataFrame([("a", "y", 2), ("a", "x", 1), ("a", None, 0), ("b", None, 5), ("c", "q", 9), ("c", "q", 3),
                                ("c", "p", 4)], "k string, v string, o int")
    assert {(r[0], r[1]) for r in frequency.primary_value(df, "k", "v", "top").collect()} == {("a", "x"), ("c", "q")}
    firsts = {(r["k"], r["o"]) for r in frequency.first_row_per_key(df, "k", ["o"]).collect()}
    assert firsts == {("a", 0), ("b", 5), ("c", 3)}


def test_key_checks(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "k string")
    assert keys.duplicate_count(df, "k").first()[0] == 2  # nulls repeat each other
    with pytest.raises(ValueError, match="missing"):
        keys.assert_unique_key(df, "k")
    with pytest.raises(ValueError, match="unique"):
        keys.assert_unique_key(df.where("k is not null"), "k")
    parent = spark.createDataFrame([("a",)], "p string")
    assert keys.orphan_rows(df, "k", parent, "p").first()[0] == 1
    with pytest.raises(ValueError):
        keys.one_to_one_join(df, df, "k")
    found, count = keys.hot_keys(df, "k", 1)
    assert count == 2


def test_rounding_keeps_large_values(spark):
    from ledgerscope.functions.numbers import round_half_up

    for value, digits in ((1.0e13, 6), (1.5e15, 6), (2.0e17, 2), (-1.5e15, 6), (1234.565, 2), (-0.005, 2)):
        got = spark.range(1).select(round_half_up(F.lit(value), digits)).first()[0]
        want = spark.range(1).select(F.round(F.lit(str(value)).cast("decimal(38,8)"), digits).cast("double")).first()[0]
        assert got == want


def test_first_row_takes_missing_orders_last(spark):
    from ledgerscope.operators.frequency import first_row_per_key

    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("b", None, 3)], "k string, o int, v int")
    assert sorted(tuple(r) for r in first_row_per_key(df, "k", ["o", "v"]).collect()) == [("a", 5, 2), ("b", None, 3)]


def test_intermediates_are_removed_on_request(tmp_path):
    """In an application of its own, as the folder belongs to the whole application."""
    import os
    import subprocess
    import sys

    code = f"""
import os
from ledgerscope.session import build_session, new_folder, remove_intermediates, write_and_read
spark = build_session("cleanup", master="local[1]", shuffle_partitions=1)
assert write_and_read(spark.range(3), new_folder(spark, "kept")).count() == 3
own = lambda: sum(n.startswith("ledgerscope-") for n in os.listdir({str(tmp_path)!r}))
print(own(), remove_intermediates(spark), own())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": f"--conf spark.checkpoint.dir={tmp_path} pyspark-shell"}
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["1", "True", "0"], done.stderr[-2000:]
