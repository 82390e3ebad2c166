"""Raw bank transactions derived from the driver's ``orders``, ``customer`` and ``nation`` tables.

One raw transaction per order, every order used. Each customer key is spread over
up to forty accounts, so that customers with one, few and many transactions all occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerscope.schemas import RAW_COLUMNS
from ledgerscope.session import spread_rows


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    orders = scan("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    people = scan("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    nations = scan("nation").select("n_nationkey", "n_name")
    joined = (orders.join(people, F.col("c_custkey") == F.col("o_custkey"))
              .join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
              .select(*orders.columns, "c_acctbal", "n_name"))
    # Dealt after the join, whose tasks may hold any number of rows; parsing is what takes time.
    joined = spread_rows(joined, orders.count())

    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda c: c.cast("string")
    every = lambda c, n: c % n == 0
    dob = (F.when(every(cust, 41), F.lit(None)).when(every(cust, 17), "1/1/1800").when(every(cust, 53), "31/2/85")
           .otherwise(F.concat_ws("/", text(1 + cust % 28), text(1 + cust % 12), text(30 + cust * 7 % 60))))
    gender = (F.when(every(order, 199), "T").when(every(order, 97), F.lit(None))
              .when(every(cust, 2), " m").otherwise("F"))
    place = F.when(order % 211 != 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit("  ,"),
                                              F.when(every(order, 5), "north").otherwise("Main"), F.lit(" ")))
    balance = F.when(order % 443 != 0, F.col("c_acctbal") + (order % 7 * 10).cast("double"))
    day = F.concat_ws("/", text(F.dayofmonth("o_orderdate")), text(F.month("o_orderdate")),
                      F.lpad(text(F.year("o_orderdate") % 100), 2, "0"))
    clock = F.when(every(order, 389), 250000).otherwise(
        order * 7919 % 24 * 10000 + order * 31 % 60 * 100 + order % 60)
    cents = F.floor(F.col("o_totalprice") / (1 + order * 7919 % 9973).cast("double") * 100)
    values = [
        F.concat(F.lit("T"), text(order)),
        F.concat(F.lit("C"), text(cust), F.lit("-"), text(order % (1 + cust % 40))),
        dob, gender, place, balance, day, clock.cast("bigint"), cents.cast("double") / 100.0,
    ]
    return joined.select(*[v.alias(name) for v, name in zip(values, RAW_COLUMNS)])
