"""Panels and text logs derived from the given tables, whole tables each."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel import Panel, stored
from chronopanel.plans.spec import BASE_COLUMNS

# Amounts have two decimal places, so means are taken exactly.
PANEL = Panel("id", "t", exact_scale=2)
ONE_DAY = "2017-01-01"
# Borders of the parts in which the orders panel is appended, and the snapshot that is frozen.
APPENDS = (dt.date(1900, 1, 1), dt.date(1998, 1, 1), dt.date(1998, 4, 1), dt.date(2100, 1, 1))
FROZEN = dt.date(1997, 6, 1)
# Buckets by entity; at scale as many as a shuffle would have partitions.
BUCKETS = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def amount(value: Column) -> Column:
    return F.sum(value.cast("decimal(18,2)")).cast("double")


def orders_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Customer x month: price, price of finished orders (null without any), number of orders."""
    orders = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    return stored(
        orders.groupBy(F.col("o_custkey").alias("id"), F.trunc("o_orderdate", "MM").alias("t")).agg(
            amount(price).alias("price"),
            amount(F.when(F.col("o_orderstatus") == "F", price)).alias("finished"),
            F.count(F.lit(1)).cast("double").alias("n_orders"),
        )
    )


def events_panel(spark: SparkSession, sf: str) -> DataFrame:
    """User x day: summed value, number of events, summed value of purchases (null without any)."""
    events = table(spark, sf, "events")
    value = F.col("value")
    return stored(
        events.groupBy(F.col("user_id").alias("id"), F.to_date("ts").alias("t")).agg(
            amount(value).alias("value"),
            F.count(F.lit(1)).cast("double").alias("n_events"),
            amount(F.when(F.col("event_type") == "purchase", value)).alias("bought"),
        )
    )


def parts_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Part x ship month: revenue, quantity, returned quantity (null without any)."""
    items = table(spark, sf, "lineitem")
    quantity = F.col("l_quantity")
    return stored(
        items.groupBy(F.col("l_partkey").alias("id"), F.trunc("l_shipdate", "MM").alias("t")).agg(
            amount(F.col("l_extendedprice")).alias("revenue"),
            amount(quantity).alias("quantity"),
            amount(F.when(F.col("l_returnflag") == "R", quantity)).alias("returned"),
        )
    )


def customers_once(spark: SparkSession, sf: str) -> DataFrame:
    """All customers in one snapshot: the shape of the shipped input table."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.lit(ONE_DAY).cast("date").alias("t"), F.col("c_acctbal").alias("balance")
    )


def shipped_table(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and their orders in the 24 value columns of the shipped input table."""
    orders = table(spark, sf, "orders")
    price, year = F.col("o_totalprice"), F.year("o_orderdate")
    finished = F.when(F.col("o_orderstatus") == "F", price)

    def number_of(condition: Column) -> Column:
        return F.count(F.when(condition, 1)).cast("double")

    per_customer = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("PAY_0"),
        *[number_of(F.col("o_orderpriority").startswith(str(i))).alias(f"PAY_{i + 1}") for i in range(1, 6)],
        *[amount(F.when(year == 1994 + i, price)).alias(f"BILL_AMT{i}") for i in range(1, 7)],
        *[amount(F.when(year == 1994 + i, finished)).alias(f"PAY_AMT{i}") for i in range(1, 7)],
        number_of(F.col("o_orderstatus") == "P").alias("default_payment_next_month"),
    )
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_acctbal").alias("LIMIT_BAL"),
        (F.col("c_nationkey") % 2 + 1).cast("double").alias("SEX"),
        F.length("c_mktsegment").cast("double").alias("EDUCATION"),
        (F.col("c_nationkey") % 3).cast("double").alias("MARRIAGE"),
        (F.col("c_nationkey") + 20).cast("double").alias("AGE"),
    )
    return customers.join(per_customer, "c_custkey", "left").select(F.col("c_custkey").alias("id"), *BASE_COLUMNS)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def epoch_text(us: Column) -> Column:
    """Seconds with three decimals, as jobs print them."""
    ms = F.call_function("div", us, F.lit(1000))
    return F.concat(
        F.call_function("div", ms, F.lit(1000)).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0")
    )


def marker_log(spark: SparkSession, sf: str) -> DataFrame:
    """One marker line per event; the tag is the user, errors are failed stops."""
    kind, ts = F.col("event_type"), F.col("ts")
    message = (
        F.when(kind == "error", F.lit("STOP FAILED"))
        .when(kind == "purchase", F.lit("STOP"))
        .otherwise(F.concat(F.lit("START("), kind, F.lit(" "), F.col("event_id").cast("string"), F.lit(")")))
    )
    return table(spark, sf, "events").select(
        F.concat(
            F.lpad(F.col("user_id").cast("string"), 6, "0"),
            F.lit("__MEASURE__ "),
            message,
            F.lit(": "),
            F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
            F.lit(" "),
            epoch_text(micros(ts)),
        ).alias("value")
    )


def feature_log(spark: SparkSession, sf: str) -> DataFrame:
    """One "generating features" line per event, the column being the event type."""
    return table(spark, sf, "events").select(
        F.concat(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
            F.lit("| Generating features for column: "),
            F.col("event_type"),
        ).alias("value")
    )


def job_log(spark: SparkSession, sf: str) -> DataFrame:
    """One heartbeat line per event."""
    return table(spark, sf, "events").select(
        F.concat(
            F.lit("___HEARTBEAT___:"),
            (micros(F.col("ts")) * 1000).cast("string"),
            F.lit(","),
            F.col("event_id").cast("string"),
        ).alias("value")
    )


def metric_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Metric samples out of events: dotted names, single names and stack traces."""
    kind = F.col("event_type")
    name = (
        F.when(kind == "error", F.lit("cpu.trace.error"))
        .when(kind == "signup", kind)
        .when(kind == "view", F.lit("heap.used"))
        .otherwise(F.concat(F.lit("app."), kind, F.lit(".value")))
    )
    return table(spark, sf, "events").select(
        F.concat(name, F.lit(",pid="), F.col("user_id").cast("string"), F.lit(",role=worker")).alias("key"),
        F.call_function("div", micros(F.col("ts")), F.lit(1000)).alias("epoch_ms"),
        "value",
    )


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One column whose name is a CSV header and whose values are CSV records, some of them bad, by the order's key."""
    id_, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    day, status = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderstatus")
    bad = {
        7: (id_, F.lit("n/a"), day, status),
        9: (id_, price),
        11: (F.lit(""), price, day, status),
        13: (id_, price, F.lit("31.12.1997"), status),
        15: (id_, F.lit("n/a"), F.lit("n/a"), status),
        17: (id_, price, day, status, F.lit("more")),
        19: (F.lit(""), F.lit("n/a"), day, status),
    }
    line = F.concat_ws(",", id_, price, day, status)
    for rest, fields in bad.items():
        line = F.when(F.col("o_orderkey") % 25 == rest, F.concat_ws(",", *fields)).otherwise(line)
    return table(spark, sf, "orders").select(line.alias("id,price,day,status"))


def weekly_job_log(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the job log and the week they are of."""
    week = F.date_format(F.date_trunc("WEEK", "ts"), "yyyy-MM-dd").alias("run")
    beat = F.concat(F.lit("___HEARTBEAT___:"), (micros(F.col("ts")) * 1000).cast("string"), F.lit(","), F.col("event_id").cast("string"))
    return table(spark, sf, "events").select(week, beat.alias("value"))
