"""Star schema: two dimensions, one fact, one feature mart, with integrity checks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerscope.functions.numbers import bool_to_int
from ledgerscope.functions.text import strip_blank
from ledgerscope.operators.keys import key_problems, orphan_rows
from ledgerscope.operators.ordering import with_row_number
from ledgerscope.schemas import CLEAN_COLUMNS, FEATURE_COLUMNS
from ledgerscope.session import cut_lineage

# The columns of the customer dimension.
CUSTOMER_COLUMNS = [
    "customer_id", "gender", "customer_age", "primary_location_id",
    "first_transaction_date", "last_transaction_date",
]
FACT_COLUMNS = [c for c in CLEAN_COLUMNS if c != "customer_location"] + ["location_id"]
MART_COLUMNS = [c for c in FEATURE_COLUMNS if c not in ("gender", "primary_location")] + ["primary_location_id"]
TABLES = ["dim_location", "dim_customer", "fact_transaction", "customer_feature_mart"]


@dataclass
class Warehouse:
    dim_location: DataFrame
    dim_customer: DataFrame
    fact_transaction: DataFrame
    customer_feature_mart: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.fact_transaction.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def collect_locations(clean: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct trimmed location names of both tables."""
    name = lambda df, c: df.select(strip_blank(F.col(c)).alias("location_name"))
    both = name(clean, "customer_location").distinct().union(name(features, "primary_location").distinct())
    return both.where(F.col("location_name").isNotNull()).distinct()


def build_dim_location(clean: DataFrame, features: DataFrame) -> DataFrame:
    """Surrogate ids 1..n in name order."""
    numbered = with_row_number(collect_locations(clean, features), [F.col("location_name")], "location_id")
    return numbered.select(F.col("location_id").cast("int").alias("location_id"), "location_name")


def attach_location_id(df: DataFrame, name_column: str, id_column: str, dim_location: DataFrame,
                       trim: bool = True) -> DataFrame:
    """Left lookup of a location name. ``trim=False`` leaves names with outer blanks unmatched."""
    lookup = dim_location.select(F.col("location_id").alias(id_column), F.col("location_name").alias("_name"))
    name = strip_blank(F.col(name_column)) if trim else F.col(name_column)
    return df.join(lookup, name == F.col("_name"), "left").drop("_name")


def build_dim_customer(features: DataFrame, dim_location: DataFrame) -> DataFrame:
    narrow = features.select("primary_location", *[c for c in CUSTOMER_COLUMNS if c != "primary_location_id"])
    return attach_location_id(narrow, "primary_location", "primary_location_id", dim_location).select(CUSTOMER_COLUMNS)


def build_customer_feature_mart(features: DataFrame, dim_location: DataFrame) -> DataFrame:
    linked = attach_location_id(features, "primary_location", "primary_location_id", dim_location)
    single = bool_to_int(F.col("is_single_transaction_customer"))
    return linked.drop("gender", "primary_location").withColumn("is_single_transaction_customer", single).select(
        MART_COLUMNS)


def build_fact_transaction(clean: DataFrame, dim_location: DataFrame) -> DataFrame:
    linked = attach_location_id(clean, "customer_location", "location_id", dim_location)
    return linked.drop("customer_location").withColumn("is_weekend", bool_to_int(F.col("is_weekend"))).select(
        FACT_COLUMNS)


def _write_by_customer(df: DataFrame, path: str, table: str, buckets: int, overwrite: bool) -> DataFrame:
    """Bucketed by customer, so that customer joins read both sides without a shuffle."""
    spark = df.sparkSession
    (df.repartition(buckets, "customer_id").write.mode("overwrite" if overwrite else "errorifexists")
     .format("parquet").bucketBy(buckets, "customer_id").sortBy("customer_id")
     .option("path", path).saveAsTable(table))
    return spark.table(table)


def write_warehouse(clean: DataFrame, features: DataFrame, path: str, name: str,
                    overwrite: bool = True, partition_fact_by: str | None = None, buckets: int | None = None) -> Warehouse:
    """Write the four tables below ``path``; without ``overwrite`` an existing table raises.

    ``buckets`` is the number of files of each customer table, the session's shuffle width by
    default: choose it so that a bucket of the largest expected mart fits a task.

    Customer tables hold unique keys, so bucketing them cannot skew; the fact is
    left unbucketed because one customer may own a large part of it.
    """
    spark = clean.sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    build_dim_location(clean, features).write.mode(mode).parquet(f"{path}/dim_location")
    dim_location = spark.read.parquet(f"{path}/dim_location")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fact = build_fact_transaction(clean, dim_location).write.mode(mode)
    if partition_fact_by:
        fact = fact.partitionBy(partition_fact_by)
    fact.parquet(f"{path}/fact_transaction")
    return Warehouse(
        dim_location=dim_location,
        dim_customer=_write_by_customer(build_dim_customer(features, dim_location), f"{path}/dim_customer",
                                        f"{name}_dim_customer", buckets, overwrite),
        fact_transaction=spark.read.parquet(f"{path}/fact_transaction"),
        customer_feature_mart=_write_by_customer(build_customer_feature_mart(features, dim_location),
                                                 f"{path}/customer_feature_mart", f"{name}_mart", buckets, overwrite),
    )


def table_counts(wh: Warehouse) -> DataFrame:
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
              for name, df in wh.tables().items()]
    return reduce(DataFrame.unionByName, counts)


def orphan_transactions(wh: Warehouse) -> DataFrame:
    """One row: fact rows whose customer is missing from the dimension."""
    return orphan_rows(wh.fact_transaction, "customer_id", wh.dim_customer, "customer_id").select(
        F.col("orphans").alias("orphan_transactions"))


def _named(check: str, one_value: DataFrame) -> DataFrame:
    value = F.col(one_value.columns[0]).cast("bigint")
    return one_value.select(F.lit(check).alias("check"), value.alias("violations"))


def fact_links(wh: Warehouse) -> DataFrame:
    """Fact rows per pair of customer and location: one pass serves both foreign keys."""
    return wh.fact_transaction.groupBy("customer_id", "location_id").agg(F.count(F.lit(1)).alias("n"))


def foreign_key_violations(wh: Warehouse, links: DataFrame | None = None) -> DataFrame:
    """Rows per foreign key whose non-null value has no parent. ``links``: counted fact links, where they exist."""
    fact = fact_links(wh) if links is None else links
    checks = [
        ("fact_transaction.customer_id", fact, "customer_id", wh.dim_customer, "customer_id"),
        ("fact_transaction.location_id", fact, "location_id", wh.dim_location, "location_id"),
        ("dim_customer.primary_location_id", wh.dim_customer, "primary_location_id", wh.dim_location, "location_id"),
        ("customer_feature_mart.customer_id", wh.customer_feature_mart, "customer_id", wh.dim_customer, "customer_id"),
        ("customer_feature_mart.primary_location_id", wh.customer_feature_mart, "primary_location_id",
         wh.dim_location, "location_id"),
    ]
    return reduce(DataFrame.unionByName, [
        _named(label, orphan_rows(*check, weight="n" if label.startswith("fact") else None)) for label, *check in checks])


def _key_checks(wh: Warehouse) -> list[DataFrame]:
    keys = {"dim_location": ["location_id", "location_name"], "dim_customer": ["customer_id"],
            "fact_transaction": ["transaction_id"], "customer_feature_mart": ["customer_id"]}
    checks = []
    for table, columns in keys.items():
        for column in columns:
            found = key_problems(wh.tables()[table], column)
            # Surplus null rows are already among the nulls.
            bad = found.select(F.col("duplicate_rows") + F.least(F.col("null_keys"), F.lit(1)))
            checks.append(_named(f"{table}.{column} key", bad))
    return checks


def _rule_checks(wh: Warehouse, rules: dict[str, dict[str, Column]]) -> list[DataFrame]:
    """Rows that break a rule; all rules of a table in one pass. A missing value breaks none."""
    parts = []
    for table, tests in rules.items():
        one = wh.tables()[table].agg(*[F.count_if(~rule).alias(f"c{i}") for i, rule in enumerate(tests.values())])
        cells = F.array(*[F.struct(F.lit(f"{table}.{name}").alias("check"), F.col(f"c{i}").cast("bigint").alias("violations"))
                          for i, name in enumerate(tests)])
        parts.append(one.select(F.inline(cells)))
    return parts


def _required() -> dict[str, dict[str, Column]]:
    return {"fact_transaction": {"customer_id not null": F.col("customer_id").isNotNull()},
            "customer_feature_mart": {"transaction_count not null": F.col("transaction_count").isNotNull()}}


def _domains() -> dict[str, dict[str, Column]]:
    gender = F.col("gender").isin("M", "F")
    return {
        "dim_customer": {"gender domain": gender, "customer_age domain": F.col("customer_age").between(18, 100)},
        "fact_transaction": {"gender domain": gender, "transaction_hour domain": F.col("transaction_hour").between(0, 23),
                             "is_weekend domain": F.col("is_weekend").isin(0, 1)},
        "customer_feature_mart": {
            "is_single_transaction_customer domain": F.col("is_single_transaction_customer").isin(0, 1)},
    }


def key_violations(wh: Warehouse) -> DataFrame:
    """Primary keys and the unique location name (null or repeated), and required columns."""
    return reduce(DataFrame.unionByName, _key_checks(wh) + _rule_checks(wh, _required()))


def domain_violations(wh: Warehouse) -> DataFrame:
    """Rows that break a value rule; a missing value is always allowed."""
    return reduce(DataFrame.unionByName, _rule_checks(wh, _domains()))


def integrity_report(wh: Warehouse) -> DataFrame:
    """Every structural, referential and domain check as (check, violations).

    The fact is read three times: for its key, for its links, and for all its rules.
    """
    links = foreign_key_violations(wh, cut_lineage(fact_links(wh)))
    orphans = (F.col("check") == "fact_transaction.customer_id")
    links = cut_lineage(links)  # five rows, two of them read twice
    required, domains = _required(), _domains()
    rules = {t: {**required.get(t, {}), **domains.get(t, {})} for t in {**domains, **required}}
    parts = [links.where(orphans).select(F.lit("orphan_transactions").alias("check"), "violations"), links,
             *_key_checks(wh), *_rule_checks(wh, rules)]
    return reduce(DataFrame.unionByName, parts)


def assert_integrity(wh: Warehouse) -> DataFrame:
    """Fail the build on any violation, else return the evaluated checks."""
    report = integrity_report(wh)
    checks = report.collect()
    broken = [r for r in checks if r["violations"]]
    if broken:
        raise RuntimeError("Warehouse integrity checks failed: "
                           + ", ".join(f"{r['check']}={r['violations']}" for r in broken))
    return wh.spark.createDataFrame(checks, report.schema)


def warehouse_build_summary(wh: Warehouse) -> DataFrame:
    """One row: loaded rows, table counts and the two referential totals."""
    links = cut_lineage(foreign_key_violations(wh))  # five rows
    named = table_counts(wh).select(F.col("table_name").alias("name"), F.col("row_count").alias("value")).unionByName(
        links.agg(F.sum("violations").alias("value")).select(F.lit("foreign_key_violations").alias("name"), "value")).unionByName(
        links.where(F.col("check") == "fact_transaction.customer_id").select(
            F.lit("orphan_transactions").alias("name"), F.col("violations").alias("value")))
    of = lambda t, name: F.max(F.when(F.col("name") == t, F.col("value"))).alias(name)
    return named.agg(
        of("customer_feature_mart", "customer_rows_loaded"), of("fact_transaction", "transaction_rows_loaded"),
        *[of(t, f"{t}_rows") for t in TABLES],
        of("foreign_key_violations", "foreign_key_violations"), of("orphan_transactions", "orphan_transactions"))


def build_warehouse(clean: DataFrame, features: DataFrame, path: str, name: str, overwrite: bool = True) -> Warehouse:
    """Write the tables, then pass the integrity gate."""
    wh = write_warehouse(clean, features, path, name, overwrite)
    assert_integrity(wh)
    return wh
