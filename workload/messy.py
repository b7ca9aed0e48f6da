"""Dirt derived from the given tables by key arithmetic, as DataFrames and as the same thing in SQL.

The given tables are clean; every expression here exists twice, once per engine, and depends
on keys only, so both engines see the same mess at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicebox.table import ROW_NO


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by(key: Column, n: int, cases: dict[int, Column], other: Column) -> Column:
    out = other
    for i, value in cases.items():
        out = F.when(key % n == i, value).otherwise(out)
    return out


def _four_layouts(key: Column, ts: Column) -> Column:
    return _by(
        key, 4,
        {0: F.date_format(ts, "yyyy/MM/dd"), 1: F.date_format(ts, "MM/dd/yyyy"), 2: F.date_format(ts, "yyyy-MM-dd")},
        F.date_format(ts, "dd-MM-yyyy"),
    )


def _four_layouts_sql(key: str, ts: str) -> str:
    return (
        f"CASE {key} % 4 WHEN 0 THEN strftime({ts}, '%Y/%m/%d') WHEN 1 THEN strftime({ts}, '%m/%d/%Y') "
        f"WHEN 2 THEN strftime({ts}, '%Y-%m-%d') ELSE strftime({ts}, '%d-%m-%Y') END"
    )


def messy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a shop export: copies of every tenth order, half of them better filled."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    copies = F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    o = o.withColumn("copy", F.explode(copies))
    label = F.when(F.col("o_orderstatus") == "O", "shipped").when(F.col("o_orderstatus") == "F", "canceled").otherwise("pending")
    money = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    better = (F.col("copy") == 1) & (k % 20 == 10)
    return o.select(
        F.concat(F.lit("ORD-"), F.lpad(k.cast("string"), 9, "0")).alias("order_id"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("customer_name"),
        _by(k, 4, {0: F.concat(F.lit("  "), F.upper(label), F.lit(" ")), 1: F.concat(label, F.lit(" "))}, label).alias("status"),
        _by(k, 5, {
            0: F.concat(F.lit("$"), money),
            1: F.concat(money, F.lit(" ")),
            2: F.regexp_replace(money, r"([0-9])([0-9]{3}\.)", "$1,$2"),
        }, money).alias("amount"),
        _four_layouts(k, F.col("o_orderdate")).alias("order_date"),
        F.when(better, "Copy City").when(k % 6 == 0, F.lit(None)).when(k % 9 == 0, "  ")
        .otherwise(F.concat(F.lit("City "), (k % 50).cast("string"))).alias("city"),
        F.when(k % 6 == 0, F.lit(None)).when(k % 7 == 0, F.concat(F.lit(" "), F.col("o_orderpriority")))
        .otherwise(F.col("o_orderpriority")).alias("state"),
        (k * 2 + F.col("copy")).alias(ROW_NO),
    )


MESSY_ORDERS_SQL = f"""
messy_orders AS (
  SELECT 'ORD-' || lpad(CAST(k AS VARCHAR), 9, '0') AS order_id,
         'Customer ' || CAST(custkey AS VARCHAR) AS customer_name,
         CASE k % 4 WHEN 0 THEN '  ' || upper(label) || ' ' WHEN 1 THEN label || ' ' ELSE label END AS status,
         CASE k % 5 WHEN 0 THEN '$' || money WHEN 1 THEN money || ' '
              WHEN 2 THEN regexp_replace(money, '([0-9])([0-9]{{3}}\\.)', '\\1,\\2') ELSE money END AS amount,
         {_four_layouts_sql("k", "odate")} AS order_date,
         CASE WHEN copy = 1 AND k % 20 = 10 THEN 'Copy City' WHEN k % 6 = 0 THEN NULL WHEN k % 9 = 0 THEN '  '
              ELSE 'City ' || CAST(k % 50 AS VARCHAR) END AS city,
         CASE WHEN k % 6 = 0 THEN NULL WHEN k % 7 = 0 THEN ' ' || prio ELSE prio END AS state,
         k * 2 + copy AS _row_no
  FROM (
    SELECT o_orderkey AS k, o_custkey AS custkey, o_orderdate AS odate, o_orderpriority AS prio, copy,
           CASE o_orderstatus WHEN 'O' THEN 'shipped' WHEN 'F' THEN 'canceled' ELSE 'pending' END AS label,
           CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS money
    FROM orders, (SELECT 0 AS copy UNION ALL SELECT 1) c
    WHERE copy = 0 OR o_orderkey % 10 = 0
  ) b
)"""


def messy_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a contact export under old column names."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.regexp_replace(F.lower("c_name"), "#", " o'")
    segment = F.when(k % 4 == 0, "vip").when(k % 4 == 1, "Wholesale").when(k % 4 == 2, "RETAIL").otherwise("loyalty")
    mail = F.concat(F.lit("Customer."), k.cast("string"), F.when(k % 11 == 0, "_example.com").otherwise("@example.com"))
    joined = F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, CAST(c_custkey % 1000 AS INT))")
    return c.select(
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 7, "0")).alias("customer_id"),
        _by(k, 3, {0: F.concat(F.lit(" "), name, F.lit("  ")), 1: F.upper(name)}, name).alias("full_name"),
        _by(k, 3, {1: F.concat(F.lit(" "), F.upper(mail))}, mail).alias("email"),
        _by(k, 5, {0: F.concat(segment, F.lit(" "))}, segment).alias("customer_segment"),
        _four_layouts(k, joined).alias("signup_date"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("555-"), F.lpad((k % 10000).cast("string"), 4, "0"))).alias("phone"),
        (k * 1).alias(ROW_NO),
    )


MESSY_CUSTOMERS_SQL = f"""
messy_customers AS (
  SELECT 'C' || lpad(CAST(k AS VARCHAR), 7, '0') AS customer_id,
         CASE k % 3 WHEN 0 THEN ' ' || nm || '  ' WHEN 1 THEN upper(nm) ELSE nm END AS full_name,
         CASE k % 3 WHEN 1 THEN ' ' || upper(mail) ELSE mail END AS email,
         CASE WHEN k % 5 = 0 THEN seg || ' ' ELSE seg END AS customer_segment,
         {_four_layouts_sql("k", "joined")} AS signup_date,
         CASE WHEN k % 7 = 0 THEN NULL ELSE '555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS phone,
         k AS _row_no
  FROM (
    SELECT c_custkey AS k, replace(lower(c_name), '#', ' o''') AS nm,
           CASE c_custkey % 4 WHEN 0 THEN 'vip' WHEN 1 THEN 'Wholesale' WHEN 2 THEN 'RETAIL' ELSE 'loyalty' END AS seg,
           'Customer.' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 11 = 0 THEN '_example.com' ELSE '@example.com' END AS mail,
           TIMESTAMP '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) * INTERVAL 1 DAY AS joined
    FROM customer
  ) b
)"""


def messy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a text log: gaps in the value, three layouts of the time."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    stamp = _by(
        k, 3,
        {0: F.date_format("ts", "yyyy/MM/dd HH:mm"), 1: F.date_format("ts", "MM/dd/yyyy HH:mm")},
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    )
    return e.select(
        k.cast("string").alias("event_id"),
        stamp.alias("ts_text"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("value").cast("decimal(12,2)").cast("string")).alias("value_text"),
        F.lit(None).cast("string").alias("note"),
        (k * 1).alias(ROW_NO),
    )


MESSY_EVENTS_SQL = """
messy_events AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y/%m/%d %H:%M') WHEN 1 THEN strftime(ts, '%m/%d/%Y %H:%M')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS ts_text,
         CAST(user_id AS VARCHAR) AS user_id,
         event_type,
         CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS value_text,
         CAST(NULL AS VARCHAR) AS note,
         event_id AS _row_no
  FROM events
)"""


def appointments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events per appointment, updated at different times, written in different layouts."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    who = F.when(k % 4 < 2, "alex cole").otherwise(" Sam Reed")
    line = F.when(k % 6 < 2, "delivery").when(k % 6 < 4, " INSTALL ").otherwise("return pickup")
    return e.select(
        F.concat(F.lit("APT-"), F.lpad(F.floor(k / 2).cast("string"), 8, "0")).alias("appointment_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("customer_name"),
        line.alias("service_line"),
        F.when(k % 10 == 0, F.lit(None)).otherwise(who).alias("technician"),
        _by(k, 3, {0: F.date_format("ts", "yyyy/MM/dd HH:mm"), 1: F.date_format("ts", "MM/dd/yyyy HH:mm")},
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("appointment_time"),
        F.col("event_type").alias("status"),
        F.when(k % 8 == 1, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit(" note"))).alias("notes"),
        _by(k, 2, {0: F.date_format("ts", "yyyy-MM-dd HH:mm")}, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("updated_at"),
        (k * 1).alias(ROW_NO),
    )


APPOINTMENTS_SQL = """
appointments AS (
  SELECT 'APT-' || lpad(CAST(event_id // 2 AS VARCHAR), 8, '0') AS appointment_id,
         'user ' || CAST(user_id AS VARCHAR) AS customer_name,
         CASE WHEN event_id % 6 < 2 THEN 'delivery' WHEN event_id % 6 < 4 THEN ' INSTALL ' ELSE 'return pickup' END AS service_line,
         CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 4 < 2 THEN 'alex cole' ELSE ' Sam Reed' END AS technician,
         ts, event_type AS status,
         CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y/%m/%d %H:%M') WHEN 1 THEN strftime(ts, '%m/%d/%Y %H:%M')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS appointment_time,
         CASE WHEN event_id % 8 = 1 THEN '' ELSE ' ' || event_type || ' note' END AS notes,
         event_id AS _row_no
  FROM events
)"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a sales series with gaps in the quantity; row order is (order, line, part, supplier)."""
    l = table(spark, sf_dir, "lineitem")
    k = F.col("l_orderkey")
    group = F.when(F.col("l_returnflag") == "A", "footwear").when(F.col("l_returnflag") == "N", " HOME goods ").otherwise("Accessories ")
    return l.select(
        _four_layouts(k, F.col("l_shipdate")).alias("date"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("l_quantity").cast("int").cast("string")).alias("quantity_sold"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("revenue"),
        group.alias("category"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
