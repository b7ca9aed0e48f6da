"""One query per operator over the given tables, each with the same result in SQL.

``QUERIES[name](spark, sf_dir)`` builds the DataFrame; ``SQL[name]`` is the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluicebox.functions import dates, numbers, text
from sluicebox.operators import cells, columns, compare, fills, profile, rows, validate
from sluicebox.operators.positions import POSITION, with_position
from sluicebox.plans import actions as A
from sluicebox.plans import packs, rulepack
from sluicebox.plans.history import TablePlan, plan_metrics, step_reports
from sluicebox.plans.suggest import suggestions
from sluicebox.session import stage, staging_path
from sluicebox.sources import csv as csv_source
from sluicebox.sources import export
from sluicebox.streaming import clean_stream
from sluicebox.table import ROW_NO, data_columns, from_frame, preview

from . import messy
from .messy import APPOINTMENTS_SQL, MESSY_CUSTOMERS_SQL, MESSY_EVENTS_SQL, MESSY_ORDERS_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_CTES = {
    "messy_orders": MESSY_ORDERS_SQL,
    "messy_customers": MESSY_CUSTOMERS_SQL,
    "messy_events": MESSY_EVENTS_SQL,
    "appointments": APPOINTMENTS_SQL,
}


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = (), ctes: str = ""):
    """Register a query and, where SQL can say it, its oracle."""

    def wrap(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            parts = [_CTES[u] for u in uses] + ([ctes] if ctes else [])
            SQL[name] = (f"WITH {', '.join(parts)}\n" if parts else "") + sql
        return fn

    return wrap


# --- SQL helpers ---------------------------------------------------------------------------


def s_canon(c: str, with_time: bool = False) -> str:
    layouts = "['%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%d-%m-%Y', '%Y/%m/%d %H:%M', '%m/%d/%Y %H:%M', '%Y-%m-%d %H:%M', '%Y-%m-%dT%H:%M:%S']"
    return f"strftime(try_strptime(trim({c}), {layouts}), '{'%Y-%m-%dT%H:%M' if with_time else '%Y-%m-%d'}')"


def s_bare(c: str) -> str:
    return f"replace(replace(trim({c}), ',', ''), '$', '')"


def s_missing(c: str) -> str:
    return f"({c} IS NULL OR trim({c}) = '')"


_NUM = r"[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)"


def s_numeric(c: str) -> str:
    return f"regexp_full_match(rtrim({s_bare(c)}, '%'), '{_NUM}')"


def s_title(c: str) -> str:
    return (
        f"list_aggregate(list_transform(regexp_extract_all(lower({c}), '[a-z]+|[^a-z]+'), "
        "lambda t: upper(t[1]) || t[2:]), 'string_agg', '')"
    )


def s_layout(c: str) -> str:
    c = f"trim({c})"
    return (
        f"CASE WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'iso_date' "
        f"WHEN regexp_full_match({c}, '[0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}}') THEN 'year_slash_date' "
        f"WHEN regexp_full_match({c}, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN 'slash_date' "
        f"WHEN regexp_full_match({c}, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}') THEN 'dash_date' "
        f"WHEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?(Z|[+-][0-9]{{2}}:[0-9]{{2}})?') THEN 'iso_datetime' END"
    )


_STATUS = "CASE lower(trim(status)) WHEN 'shipped' THEN 'shipped' WHEN 'pending' THEN 'pending' WHEN 'cancelled' THEN 'cancelled' WHEN 'canceled' THEN 'cancelled' ELSE trim(status) END"

CLEAN_ORDERS_SQL = f"""
prepared AS (
  SELECT order_id, trim(customer_name) AS customer_name, {_STATUS} AS status,
         round(CAST({s_bare('amount')} AS DOUBLE), 2) AS amount, {s_canon('order_date')} AS order_date,
         coalesce(nullif(trim(city), ''), 'UNKNOWN') AS city, coalesce(nullif(trim(state), ''), 'UNKNOWN') AS state, _row_no
  FROM messy_orders
),
clean_orders AS (
  SELECT * FROM prepared QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY city DESC, _row_no) = 1
)"""


def _clean_orders(spark: SparkSession, sf: str) -> DataFrame:
    return rulepack.clean(messy.messy_orders(spark, sf), packs.ORDERS)


def _uploaded_orders(spark: SparkSession, sf: str) -> DataFrame:
    """messy_orders as an upload: stable ids, one padded header."""
    o = messy.messy_orders(spark, sf)
    return from_frame(o, [" order_id", "customer_name", "status", "amount", "order date", "city", "state"])


UPLOAD_COLUMNS = ["order_id", "customer_name", "status", "amount", "order_date", "city", "state"]


# --- Rule packs (GV-4, GV-5, PR-13, PR-14, VA-1..10) ---------------------------------------


@query(
    "rulepack_orders",
    "SELECT order_id, customer_name, status, amount, order_date, city, state FROM clean_orders",
    ("messy_orders",), CLEAN_ORDERS_SQL,
)
def rulepack_orders(spark, sf):
    return _clean_orders(spark, sf).drop(ROW_NO)


@query(
    "rulepack_contacts",
    f"""SELECT customer_id, {s_title('trim(full_name)')} AS contact_name, lower(trim(email)) AS email,
       CASE lower(trim(customer_segment)) WHEN 'vip' THEN 'VIP' WHEN 'wholesale' THEN 'Wholesale'
            WHEN 'retail' THEN 'Retail' WHEN 'loyalty' THEN 'Loyalty' END AS customer_segment,
       {s_canon('signup_date')} AS signup_date, coalesce(phone, 'UNKNOWN') AS phone
FROM messy_customers""",
    ("messy_customers",),
)
def rulepack_contacts(spark, sf):
    return rulepack.clean(messy.messy_customers(spark, sf), packs.CONTACTS).drop(ROW_NO)


@query(
    "rulepack_appointments",
    """SELECT appointment_id, customer_name, service_line, technician, appointment_time, status, notes, updated_at FROM (
  SELECT appointment_id, regexp_replace(customer_name, '^u', 'U') AS customer_name,
         CASE lower(trim(service_line)) WHEN 'delivery' THEN 'Delivery' WHEN 'install' THEN 'Installation' ELSE 'Returns' END AS service_line,
         CASE lower(trim(technician)) WHEN 'alex cole' THEN 'Alex Cole' WHEN 'sam reed' THEN 'Sam Reed' ELSE 'TBD' END AS technician,
         strftime(ts, '%Y-%m-%dT%H:%M') AS appointment_time, status,
         coalesce(nullif(trim(notes), ''), 'UNKNOWN') AS notes, strftime(ts, '%Y-%m-%dT%H:%M') AS updated_at, _row_no
  FROM appointments)
QUALIFY row_number() OVER (PARTITION BY appointment_id ORDER BY updated_at DESC,
  appointment_time DESC, customer_name || '"' DESC, notes || '"' DESC, service_line || '"' DESC, status || '"' DESC, technician || '"' DESC) = 1""",
    ("appointments",),
)
def rulepack_appointments(spark, sf):
    return rulepack.clean(messy.appointments(spark, sf), packs.APPOINTMENTS).drop(ROW_NO)


_SALES_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _sales(spark, sf):
    s = with_position(messy.sales(spark, sf), [F.col(c) for c in _SALES_ORDER])
    return s.withColumnRenamed(POSITION, ROW_NO).drop(*_SALES_ORDER, "l_extendedprice")


SALES_SQL = f"""
sales AS (
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, 'P' || CAST(l_partkey AS VARCHAR) AS product_id,
         CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS qty,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS revenue,
         CASE l_returnflag WHEN 'A' THEN 'Footwear' WHEN 'N' THEN 'Home Goods' ELSE 'Accessories' END AS category,
         row_number() OVER (ORDER BY {', '.join(_SALES_ORDER)}) - 1 AS _row_no
  FROM lineitem
)"""


@query(
    "rulepack_forecast",
    """SELECT date, product_id, coalesce(last_value(qty IGNORE NULLS) OVER (ORDER BY _row_no), '') AS quantity_sold,
       revenue, category, _row_no AS row_no FROM sales""",
    (), SALES_SQL,
)
def rulepack_forecast(spark, sf):
    return rulepack.clean(_sales(spark, sf), packs.FORECAST).withColumnRenamed(ROW_NO, "row_no")


@query(
    "rulepack_churn",
    f"""SELECT customer_id, CAST(k % 90 AS VARCHAR) AS recency_days,
       CASE WHEN k % 4 = 0 THEN '6' ELSE CAST(k % 12 AS VARCHAR) END AS frequency,
       round(bal, 2) AS monetary, {s_title('trim(seg)')} AS segment, CAST(k % 2 AS VARCHAR) AS churned,
       strftime(TIMESTAMP '2024-01-01' + CAST(k % 90 AS INTEGER) * INTERVAL 1 DAY, '%Y-%m-%d') AS last_purchase_date
FROM (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS customer_id, c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal FROM customer)""",
)
def rulepack_churn(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    day = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(c_custkey % 90 AS INT))")
    raw = c.select(
        F.concat(F.lit("C"), k.cast("string")).alias("customer_id"),
        (k % 90).cast("string").alias("recency_days"),
        F.when(k % 4 == 0, "").otherwise((k % 12).cast("string")).alias("frequency"),
        F.concat(F.lit("$"), F.col("c_acctbal").cast("decimal(12,2)").cast("string")).alias("monetary"),
        F.concat(F.lit(" "), F.col("c_mktsegment")).alias("segment"),
        (k % 2).cast("string").alias("churned"),
        F.date_format(day, "MM/dd/yyyy").alias("last_purchase_date"),
        (k * 1).alias(ROW_NO),
    )
    return rulepack.clean(raw, packs.CHURN).drop(ROW_NO)


@query(
    "rulepack_recommendations",
    """SELECT 'u' || CAST(user_id AS VARCHAR) AS user_id, 'SKU-' || CAST(event_id % 97 AS VARCHAR) AS item_id,
       CASE WHEN event_id % 4 = 0 THEN 3.0 ELSE CAST(event_id % 5 AS DOUBLE) + 0.5 END AS rating,
       strftime(ts, '%Y-%m-%d') AS timestamp, upper(event_type[1]) || event_type[2:] AS category, event_id AS row_no
FROM events""",
)
def rulepack_recommendations(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    raw = e.select(
        F.concat(F.lit(" U"), F.col("user_id").cast("string"), F.lit(" ")).alias("user_id"),
        F.concat(F.lit("SKU-"), (k % 97).cast("string")).alias("item_id"),
        F.when(k % 4 == 0, "").otherwise(F.concat((k % 5).cast("string"), F.lit(".5"))).alias("rating"),
        F.when(k % 2 == 0, F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "MM/dd/yyyy")).alias("timestamp"),
        F.concat(F.upper("event_type"), F.lit(" ")).alias("category"),
        (k * 1).alias(ROW_NO),
    )
    return rulepack.clean(raw, packs.RECOMMENDATIONS).withColumnRenamed(ROW_NO, "row_no")


_O = "messy_orders"


def s_count(pred: str) -> str:
    return f"count(*) FILTER (WHERE {pred})"


_REPEATS = f"(SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {_O} GROUP BY order_id))"
_MISSING_ALL = " + ".join(s_count(s_missing(c)) for c in UPLOAD_COLUMNS)


@query(
    "pack_issues_summary",
    f"""SELECT * FROM (
  SELECT 1 AS position, 'whitespace: status, amount, city' AS issue WHERE (SELECT {s_count('status <> trim(status)')} FROM {_O}) > 0
  UNION ALL SELECT 2, 'required: ' || CAST((SELECT {_MISSING_ALL} FROM {_O}) AS VARCHAR) || ' cells missing'
  UNION ALL SELECT 3, 'duplicates: business keys repeat' WHERE {_REPEATS} > 0
  UNION ALL SELECT 4, 'dates: order_date' WHERE (SELECT {s_count(f"order_date <> {s_canon('order_date')}")} FROM {_O}) > 0
  UNION ALL SELECT 5, 'values: status' WHERE (SELECT {s_count(f'status <> {_STATUS}')} FROM {_O}) > 0)""",
    (_O,),
)
def pack_issues_summary(spark, sf):
    return rulepack.issues_summary(messy.messy_orders(spark, sf), packs.ORDERS)


@query(
    "pack_suggested_steps",
    f"""SELECT * FROM (VALUES (0, 'safe', 'strip_whitespace'), (1, 'safe', 'replace_values:status'), (2, 'safe', 'standardize_date'),
  (4, 'risky', 'fill_missing:city'), (5, 'risky', 'fill_missing:state'), (6, 'risky', 'cast_dtype:amount'), (7, 'risky', 'drop_duplicates'))
  v(position, "group", step)
WHERE (step <> 'drop_duplicates' OR {_REPEATS} > 0)
  AND (step <> 'strip_whitespace' OR (SELECT {s_count('status <> trim(status)')} FROM {_O}) > 0)""",
    (_O,),
)
def pack_suggested_steps(spark, sf):
    return rulepack.suggest_pack_steps(messy.messy_orders(spark, sf), packs.ORDERS)


@query(
    "pack_profile",
    f"""SELECT count(*) AS row_count, CAST(7 AS BIGINT) AS column_count,
  'whitespace: status, amount, city; required: ' || CAST({_MISSING_ALL} AS VARCHAR) || ' cells missing; duplicates: business keys repeat; dates: order_date' AS issues,
  'strip_whitespace; replace_values:status; standardize_date' AS safe_steps,
  'fill_missing:city; fill_missing:state; cast_dtype:amount; drop_duplicates' AS risky_steps
FROM {_O}""",
    (_O,),
)
def pack_profile(spark, sf):
    p = rulepack.profile_pack(messy.messy_orders(spark, sf), packs.ORDERS)
    return p.select(
        "row_count", "column_count",
        F.array_join("issues_summary", "; ").alias("issues"),
        F.array_join("safe_steps", "; ").alias("safe_steps"),
        F.array_join("risky_steps", "; ").alias("risky_steps"),
    )


_CHECK_COUNTS = f"""
counted AS (
  SELECT {_MISSING_ALL} AS missing, {s_count(f"order_date <> {s_canon('order_date')}")} AS dates, count(*) AS n FROM {_O}
),
checks AS (
  SELECT 'required_fields_present' AS check_id, missing AS failed_count FROM counted
  UNION ALL SELECT 'schema_matches', 0
  UNION ALL SELECT 'duplicates_resolved', {_REPEATS}
  UNION ALL SELECT 'amounts_numeric_non_negative', n FROM counted
  UNION ALL SELECT 'dates_canonical', dates FROM counted
)"""


@query(
    "checks_orders_raw",
    "SELECT check_id, CASE WHEN failed_count = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(failed_count AS BIGINT) AS failed_count FROM checks",
    (_O,), _CHECK_COUNTS,
)
def checks_orders_raw(spark, sf):
    return rulepack.run_checks(messy.messy_orders(spark, sf), packs.ORDERS).select("check_id", "status", "failed_count")


@query(
    "checks_rollup",
    """SELECT CASE WHEN bool_and(failed_count = 0) THEN 'passed' ELSE 'failed' END AS validation_status,
  count(*) FILTER (WHERE failed_count = 0) AS passed, count(*) FILTER (WHERE failed_count > 0) AS failed, bool_and(failed_count = 0) AS export_ready FROM checks""",
    (_O,), _CHECK_COUNTS,
)
def checks_rollup(spark, sf):
    return rulepack.rollup(rulepack.run_checks(messy.messy_orders(spark, sf), packs.ORDERS))


@query(
    "checks_orders_clean",
    """SELECT check_id, CASE WHEN failed_count = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(failed_count AS BIGINT) AS failed_count FROM (
  SELECT 'required_fields_present' AS check_id, count(*) FILTER (WHERE trim(city) = '' OR trim(state) = '') AS failed_count FROM clean_orders
  UNION ALL SELECT 'schema_matches', 0
  UNION ALL SELECT 'duplicates_resolved', count(*) - count(DISTINCT order_id) FROM clean_orders
  UNION ALL SELECT 'amounts_numeric_non_negative', count(*) FILTER (WHERE amount IS NULL OR amount < 0) FROM clean_orders
  UNION ALL SELECT 'dates_canonical', count(*) FILTER (WHERE order_date IS NULL) FROM clean_orders)""",
    (_O,), CLEAN_ORDERS_SQL,
)
def checks_orders_clean(spark, sf):
    return rulepack.run_checks(_clean_orders(spark, sf), packs.ORDERS).select("check_id", "status", "failed_count")


@query(
    "checks_contacts",
    f"""SELECT * FROM (
  SELECT 'required_fields_present' AS check_id, count(*) FILTER (WHERE phone IS NULL) AS failed_count FROM messy_customers
  UNION ALL SELECT 'schema_matches', 1
  UNION ALL SELECT 'dates_canonical', count(*) FILTER (WHERE signup_date <> {s_canon('signup_date')}) FROM messy_customers
  UNION ALL SELECT 'emails_valid', count(*) FILTER (WHERE NOT regexp_full_match(trim(email), '[^@ ]+@[^@ ]+\\.[^@ ]+')) FROM messy_customers
  UNION ALL SELECT 'populated:phone', count(*) FILTER (WHERE phone IS NULL) FROM messy_customers
  UNION ALL SELECT 'my_own_rule', 0)""",
    ("messy_customers",),
)
def checks_contacts(spark, sf):
    from dataclasses import replace

    rules = {**packs.CONTACTS.validation_rules, "populated:phone": "Phones are known.", "my_own_rule": "Not implemented."}
    pack = replace(packs.CONTACTS, validation_rules=rules)
    return rulepack.run_checks(messy.messy_customers(spark, sf), pack).select("check_id", "failed_count")


# --- Cell cleaning (CL-1..6, CL-12, CL-13) -------------------------------------------------


@query("trim_cells", "SELECT customer_id, trim(full_name) AS full_name, trim(email) AS email FROM messy_customers", ("messy_customers",))
def trim_cells(spark, sf):
    return cells.trim_whitespace(messy.messy_customers(spark, sf), ["full_name", "email"]).select("customer_id", "full_name", "email")


@query(
    "trim_documents",
    "SELECT doc_id, length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288))) AS n FROM documents",
)
def trim_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return cells.trim_whitespace(d, ["text"]).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query(
    "trim_preview",
    """SELECT CAST(sum((full_name <> trim(full_name))::INT + (email <> trim(email))::INT) AS BIGINT) AS affected_count, 'values' AS affected_unit,
  'low' AS risk, CAST(0 AS BIGINT) AS unresolved_count FROM messy_customers""",
    ("messy_customers",),
)
def trim_preview(spark, sf):
    action = A.TrimWhitespace(("full_name", "email"))
    return A.preview_change(messy.messy_customers(spark, sf), action).select("affected_count", "affected_unit", "risk", "unresolved_count")


@query(
    "trim_samples",
    """SELECT _row_no + 2 AS row_number, 'full_name' AS column_name, full_name AS old_value, trim(full_name) AS new_value FROM messy_customers
WHERE full_name <> trim(full_name) ORDER BY _row_no LIMIT 5""",
    ("messy_customers",),
)
def trim_samples(spark, sf):
    s = A.TrimWhitespace(("full_name", "email")).samples(messy.messy_customers(spark, sf))
    return s.select(
        "row_number", F.map_keys("before")[0].alias("column_name"),
        F.map_values("before")[0].alias("old_value"), F.map_values("after")[0].alias("new_value"),
    )


@query(
    "dedup_samples",
    f"""SELECT row_number, order_id FROM (SELECT _row_no + 2 AS row_number, order_id FROM {_O}
  QUALIFY row_number() OVER (PARTITION BY {', '.join(UPLOAD_COLUMNS)} ORDER BY _row_no) > 1) ORDER BY row_number LIMIT 5""",
    (_O,),
)
def dedup_samples(spark, sf):
    s = A.DropDuplicates("first").samples(messy.messy_orders(spark, sf))
    return s.select("row_number", F.col("before")["order_id"].alias("order_id"))


@query(
    "preview_unresolved",
    f"""SELECT action, {s_count('_row_no % 14 <> 0')} AS affected_count, {s_count('_row_no % 14 = 0')} AS unresolved_count,
  CAST({s_count('_row_no % 14 = 0')} AS VARCHAR) || ' values could not be read and stay as they are.' AS warning
FROM {_O}, (VALUES ('convert_numeric'), ('standardize_date')) v(action) GROUP BY action""",
    (_O,),
)
def preview_unresolved(spark, sf):
    o = messy.messy_orders(spark, sf).select(
        *[F.when(F.col(ROW_NO) % 14 == 0, "n/a").otherwise(F.col(c)).alias(c) for c in ("amount", "order_date")], ROW_NO
    )
    out = None
    for action in (A.ConvertNumeric("amount", "decimal"), A.StandardizeDate("order_date", "month_first", "DD/MM/YYYY")):
        part = A.preview_change(o, action).select(
            F.lit(action.kind).alias("action"), "affected_count", "unresolved_count", "warning"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "stream_clean",
    f"SELECT c_custkey, {s_title('trim(c_name)')} AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer",
)
def stream_clean(spark, sf):
    schema = table(spark, sf, "customer").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(sf)
    steps = [A.TrimWhitespace(("c_name",)), A.NormalizeCase("title", "c_name"), A.NormalizeCase("lower", "c_mktsegment")]
    cleaned = clean_stream(stream.select("c_custkey", "c_name", "c_mktsegment"), steps)
    out, mark = staging_path(spark, "stream"), staging_path(spark, "stream-log")
    run = cleaned.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(out)


@query(
    "normalize_case",
    f"SELECT customer_id, {s_title('trim(full_name)')} AS full_name, lower(trim(email)) AS email, upper(trim(customer_segment)) AS customer_segment FROM messy_customers",
    ("messy_customers",),
)
def normalize_case(spark, sf):
    c = messy.messy_customers(spark, sf)
    c = cells.normalize_case(c, "title", ["full_name"])
    c = cells.normalize_case(c, "lower", ["email"])
    return cells.normalize_case(c, "upper", ["customer_segment"]).select("customer_id", "full_name", "email", "customer_segment")


@query(
    "replace_values",
    f"SELECT _row_no AS row_no, CASE lower(trim(status)) WHEN 'shipped' THEN 'S' WHEN 'canceled' THEN 'C' ELSE status END AS status FROM {_O}",
    (_O,),
)
def replace_values(spark, sf):
    o = cells.replace_values(messy.messy_orders(spark, sf), "status", {" Shipped ": "S", "CANCELED": "C"})
    return o.select(F.col(ROW_NO).alias("row_no"), "status")


@query(
    "replace_values_many",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey < 10000 THEN 'even ' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS key FROM orders",
)
def replace_values_many(spark, sf):
    """A literal mapping of 5,000 entries."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"))
    return cells.replace_values(o, "key", {str(k): f"even {k}" for k in range(0, 10_000, 2)})


@query(
    "replace_values_lookup",
    f"""SELECT m._row_no AS row_no, coalesce(CAST(c.c_mktsegment AS VARCHAR), m.customer_name) AS customer_name
FROM {_O} m LEFT JOIN customer c ON lower(trim(m.customer_name)) = 'customer ' || CAST(c.c_custkey AS VARCHAR)""",
    (_O,),
)
def replace_values_lookup(spark, sf):
    side = table(spark, sf, "customer").select(F.concat(F.lit("CUSTOMER "), F.col("c_custkey").cast("string")).alias("k"), F.col("c_mktsegment").alias("v"))
    o = cells.replace_values_from(messy.messy_orders(spark, sf), "customer_name", side, "k", "v")
    return o.select(F.col(ROW_NO).alias("row_no"), "customer_name")


@query("date_canonical", f"SELECT _row_no AS row_no, {s_canon('order_date')} AS order_date FROM {_O}", (_O,))
def date_canonical(spark, sf):
    o = cells.standardize_dates(messy.messy_orders(spark, sf), {"order_date": False})
    return o.select(F.col(ROW_NO).alias("row_no"), "order_date")


@query(
    "timestamp_canonical",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS ts_text FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, ts FROM events)",
)
def timestamp_canonical(spark, sf):
    return cells.standardize_dates(messy.messy_events(spark, sf), {"ts_text": True}).select("event_id", "ts_text")


def s_day_first(c: str) -> str:
    return f"strftime(coalesce(try_strptime(trim({c}), ['%Y/%m/%d', '%Y-%m-%d']), try_strptime(trim({c}), ['%d/%m/%Y', '%d-%m-%Y']), try_strptime(trim({c}), ['%m/%d/%Y', '%m-%d-%Y'])), '%Y-%m-%d')"


@query("date_day_first", f"SELECT _row_no AS row_no, {s_day_first('order_date')} AS order_date FROM {_O}", (_O,))
def date_day_first(spark, sf):
    o = cells.standardize_free_dates(messy.messy_orders(spark, sf), "order_date", day_first=True)
    return o.select(F.col(ROW_NO).alias("row_no"), "order_date")


@query(
    "cast_amount",
    f"SELECT _row_no AS row_no, round(CAST({s_bare('amount')} AS DOUBLE), 2) AS amount FROM {_O}", (_O,),
)
def cast_amount(spark, sf):
    return cells.cast_dtype(messy.messy_orders(spark, sf), "amount", "float", strict=True).select(F.col(ROW_NO).alias("row_no"), "amount")


@query(
    "cast_int",
    "SELECT event_id, CAST(trunc(TRY_CAST(nullif(value_text, '') AS DOUBLE)) AS BIGINT) AS value_int FROM messy_events",
    ("messy_events",),
)
def cast_int(spark, sf):
    e = cells.cast_dtype(messy.messy_events(spark, sf), "value_text", "int")
    return e.select("event_id", F.col("value_text").alias("value_int"))


@query("convert_numeric", f"SELECT _row_no AS row_no, CAST({s_bare('amount')} AS DOUBLE) AS amount FROM {_O}", (_O,))
def convert_numeric(spark, sf):
    return cells.convert_numeric(messy.messy_orders(spark, sf), "amount", "decimal").select(F.col(ROW_NO).alias("row_no"), "amount")


@query(
    "convert_numeric_mixed",
    f"SELECT _row_no AS row_no, CASE WHEN _row_no % 14 = 0 THEN 'n/a' ELSE CAST(CAST(_row_no % 1000 AS DOUBLE) / 4 AS VARCHAR) END AS amount FROM {_O}",
    (_O,),
)
def convert_numeric_mixed(spark, sf):
    o = messy.messy_orders(spark, sf).select(
        F.when(F.col(ROW_NO) % 14 == 0, "n/a").otherwise(F.concat((F.col(ROW_NO) % 1000 / 4).cast("string"), F.lit("%"))).alias("amount"), ROW_NO
    )
    return cells.convert_numeric(o, "amount", "decimal").select(F.col(ROW_NO).alias("row_no"), "amount")


# --- Fills (CL-7..11) ----------------------------------------------------------------------

_EV = "messy_events"


def _fill(strategy: str, value: str | None = None):
    def run(spark, sf):
        e = fills.fill_missing_with(messy.messy_events(spark, sf), "value_text", strategy, value)
        return e.select("event_id", "value_text")

    return run


query("fill_explicit", "SELECT event_id, coalesce(nullif(value_text, ''), 'none') AS value_text FROM messy_events", (_EV,))(_fill("explicit", "none"))
query(
    "fill_median",
    """SELECT event_id, CASE WHEN value_text <> '' THEN value_text ELSE (SELECT regexp_replace(CAST(CAST(median(CAST(value_text AS DECIMAL(12,4))) AS DECIMAL(12,4)) AS VARCHAR), '\\.?0+$', '') FROM messy_events WHERE value_text <> '') END AS value_text FROM messy_events""",
    (_EV,),
)(_fill("median"))
query(
    "fill_most_common",
    """SELECT event_id, CASE WHEN value_text <> '' THEN value_text ELSE (SELECT value_text FROM messy_events WHERE value_text <> ''
  GROUP BY value_text ORDER BY count(*) DESC, min(_row_no) LIMIT 1) END AS value_text FROM messy_events""",
    (_EV,),
)(_fill("most_common"))


@query(
    "fill_mean",
    """SELECT event_id, CASE WHEN value_text <> '' THEN value_text ELSE (SELECT CAST(round(avg(CAST(value_text AS DOUBLE)), 4) AS VARCHAR) FROM messy_events WHERE value_text <> '') END AS value_text FROM messy_events""",
    (_EV,),
)
def fill_mean(spark, sf):
    e = messy.messy_events(spark, sf)
    out = fills.fill_missing_with(e, "value_text", "mean").join(e.select(ROW_NO, F.col("value_text").alias("before")), ROW_NO)
    # The mean of doubles depends on summation order past the 12th digit: compare four decimals.
    shown = F.round(F.col("value_text").cast("double"), 4).cast("string")
    return out.select("event_id", F.when(F.col("before") == "", shown).otherwise(F.col("value_text")).alias("value_text"))


def _numbers_with_gaps(spark, sf):
    e = messy.messy_events(spark, sf).select("event_id", F.col("value_text").try_cast("double").alias("v"))
    return e.select("event_id", F.floor("v").alias("v"))


_GAPS = "(SELECT event_id, CAST(floor(TRY_CAST(value_text AS DOUBLE)) AS BIGINT) AS v FROM messy_events)"


@query("fill_mean_bigint", f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {_GAPS})), 6) AS v FROM {_GAPS}", (_EV,))
def fill_mean_bigint(spark, sf):
    return fills.fill_missing_with(_numbers_with_gaps(spark, sf), "v", "mean").select("event_id", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("fill_median_bigint", f"SELECT event_id, CAST(coalesce(v, (SELECT median(v) FROM {_GAPS})) AS DOUBLE) AS v FROM {_GAPS}", (_EV,))
def fill_median_bigint(spark, sf):
    return fills.fill_missing_with(_numbers_with_gaps(spark, sf), "v", "median").select("event_id", F.col("v").cast("double").alias("v"))


@query("fill_explicit_number", f"SELECT event_id, coalesce(CAST(v AS VARCHAR), 'n/a') AS v FROM {_GAPS}", (_EV,))
def fill_explicit_number(spark, sf):
    return fills.fill_missing_with(_numbers_with_gaps(spark, sf), "v", "explicit", "n/a")


@query(
    "fill_forward",
    "SELECT event_id, coalesce(last_value(nullif(value_text, '') IGNORE NULLS) OVER (ORDER BY _row_no), '') AS value_text FROM messy_events",
    (_EV,),
)
def fill_forward(spark, sf):
    return fills.fill_forward(messy.messy_events(spark, sf), ["value_text"]).select("event_id", "value_text")


@query(
    "fill_forward_by_user",
    "SELECT event_id, coalesce(last_value(nullif(value_text, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY _row_no), '') AS value_text FROM messy_events",
    (_EV,),
)
def fill_forward_by_user(spark, sf):
    return fills.fill_forward(messy.messy_events(spark, sf), ["value_text"], ["user_id"]).select("event_id", "value_text")


# --- Columns (CL-14..16, CL-20) ------------------------------------------------------------


@query(
    "rename_align",
    f"SELECT order_id, amount AS total, CAST(NULL AS VARCHAR) AS currency, city FROM {_O}", (_O,),
)
def rename_align(spark, sf):
    o = columns.rename_column(messy.messy_orders(spark, sf), "amount", "total")
    return columns.align_columns(o, ["order_id", "total", "currency", "city"]).drop(ROW_NO)


@query("drop_empty_columns", "SELECT event_id, ts_text, user_id, event_type, value_text FROM messy_events", (_EV,))
def drop_empty_columns(spark, sf):
    return columns.drop_empty_columns(messy.messy_events(spark, sf), ["note"]).drop(ROW_NO)


@query(
    "rename_header",
    f"SELECT row_number() OVER (ORDER BY _row_no) AS n, order_id AS \"Order Number\" FROM {_O}", (_O,),
)
def rename_header(spark, sf):
    o = columns.rename_header(_uploaded_orders(spark, sf), "column_1", " Order Number ")
    placed = with_position(o.select("column_1", ROW_NO), [F.col(ROW_NO)])
    shown = o.schema["column_1"].metadata["display_name"]
    return placed.select((F.col(POSITION) + 1).alias("n"), F.col("column_1").alias(shown))


# --- Rows (CL-17..19, SR-9) ----------------------------------------------------------------

_ALL = ", ".join(UPLOAD_COLUMNS)

for _keep, _agg in (("first", "min"), ("last", "max")):
    query(
        f"dedup_exact_{_keep}",
        f"SELECT {_ALL}, {_agg}(_row_no) AS row_no FROM {_O} GROUP BY {_ALL}", (_O,),
    )(lambda spark, sf, keep=_keep: rows.drop_duplicates(messy.messy_orders(spark, sf), keep).withColumnRenamed(ROW_NO, "row_no"))


@query(
    "dedup_survivor",
    f"""SELECT order_id, city, state, _row_no AS row_no FROM (
  SELECT *, (NOT {s_missing('city')})::INT + (NOT {s_missing('state')})::INT AS filled FROM {_O})
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY filled DESC, city DESC NULLS FIRST, _row_no) = 1""",
    (_O,),
)
def dedup_survivor(spark, sf):
    best = rows.keep_best(messy.messy_orders(spark, sf), ["order_id"], ["city", "state"])
    return best.select("order_id", "city", "state", F.col(ROW_NO).alias("row_no"))


@query(
    "dedup_survivor_latest",
    """SELECT appointment_id, _row_no AS row_no FROM appointments
QUALIFY row_number() OVER (PARTITION BY appointment_id ORDER BY (status IS NOT NULL)::INT + (NOT (notes IS NULL OR trim(notes) = ''))::INT DESC,
  strftime(ts, '%Y-%m-%dT%H:%M') DESC, appointment_time DESC) = 1""",
    ("appointments",),
)
def dedup_survivor_latest(spark, sf):
    best = rows.keep_best(messy.appointments(spark, sf), ["appointment_id"], ["status", "notes"], "updated_at")
    return best.select("appointment_id", F.col(ROW_NO).alias("row_no"))


@query(
    "sort_text_order",
    f"SELECT row_number() OVER (ORDER BY coalesce(city, '') DESC, order_date DESC, _row_no) - 1 AS place, order_id FROM {_O}",
    (_O,),
)
def sort_text_order(spark, sf):
    o = rows.sort_rows(messy.messy_orders(spark, sf), ["city", "order_date"], ascending=False)
    # Positions taken from the same order make the sort visible to an unordered comparison.
    order = [F.coalesce("city", F.lit("")), F.col("order_date")]
    placed = with_position(o.select("order_id", "city", "order_date", ROW_NO), order, [False, False])
    return placed.select(F.col(POSITION).alias("place"), "order_id")


@query(
    "sort_numbers",
    "SELECT row_number() OVER (ORDER BY CAST(l_orderkey * 1234567.5 AS DECIMAL(18,1))::VARCHAR, l_orderkey) - 1 AS place, l_orderkey "
    "FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey > 10)",
)
def sort_numbers(spark, sf):
    """Doubles beyond 1e7 in the order of their text, which is not that of Spark's own exponent form."""
    keys = table(spark, sf, "lineitem").select("l_orderkey").where("l_orderkey > 10").distinct()
    o = keys.select("l_orderkey", (F.col("l_orderkey") * 1234567.5).alias("number"), F.col("l_orderkey").alias(ROW_NO))
    order = text.render_cell(F.col("number"), T.DoubleType())
    return with_position(rows.sort_rows(o, ["number"]), [order]).select(F.col(POSITION).alias("place"), "l_orderkey")


@query(
    "preview_rows",
    f"SELECT _row_no + 2 AS row_number, {_ALL} FROM {_O} ORDER BY _row_no LIMIT 20", (_O,),
)
def preview_rows(spark, sf):
    return preview(messy.messy_orders(spark, sf))


@query(
    "canonical_positions",
    f"SELECT row_number() OVER (ORDER BY customer_name, order_id, _row_no) - 1 AS place, order_id, customer_name FROM {_O}",
    (_O,),
)
def canonical_positions(spark, sf):
    o = messy.messy_orders(spark, sf).select("order_id", "customer_name", ROW_NO)
    return with_position(o, [F.col("customer_name"), F.col("order_id")]).select(F.col(POSITION).alias("place"), "order_id", "customer_name")


# --- Profiling (PR-1..18) ------------------------------------------------------------------


def s_type(c: str, source: str) -> str:
    present = s_count(f"NOT {s_missing(c)}")
    lay, num = s_layout(c), s_numeric(c)
    return f"""(SELECT CASE WHEN {present} = 0 THEN 'empty'
  WHEN {s_count(f"lower(trim({c})) IN ('true', 'false', 'yes', 'no')")} = {present} THEN 'boolean'
  WHEN {s_count(f'({lay}) IS NOT NULL')} = {present} THEN CASE WHEN {s_count(f"({lay}) = 'iso_datetime'")} > 0 THEN 'datetime' ELSE 'date' END
  WHEN {s_count(num)} = {present} THEN CASE WHEN {s_count(f"regexp_full_match(rtrim({s_bare(c)}, '%'), '[+-]?[0-9]+')")} = {present} THEN 'integer' ELSE 'decimal' END
  WHEN {s_count(num)} > 0 THEN 'mixed' ELSE 'text' END FROM {source})"""


_TYPED = {
    "messy_orders": UPLOAD_COLUMNS,
    "messy_events": ["event_id", "ts_text", "user_id", "event_type", "value_text", "note"],
    "messy_customers": ["customer_id", "full_name", "email", "customer_segment", "signup_date", "phone"],
}


@query(
    "infer_types",
    " UNION ALL ".join(
        f"SELECT '{t}' AS source, '{c}' AS id, {s_type(c, t)} AS inferred_type" for t, cs in _TYPED.items() for c in cs
    ),
    tuple(_TYPED),
)
def infer_types(spark, sf):
    makers = {"messy_orders": messy.messy_orders, "messy_events": messy.messy_events, "messy_customers": messy.messy_customers}
    out = None
    for name, make in makers.items():
        p = profile.profile_table(make(spark, sf), with_duplicates=False, with_examples=False).columns()
        part = p.select(F.lit(name).alias("source"), "id", "inferred_type")
        out = part if out is None else out.unionByName(part)
    return out


def s_issue(kind: str, source: str, cols: list[tuple[str, str, str]], unit: str, keep: str = "TRUE") -> str:
    """An issue row from (id, expression of the cell, predicate) per column."""
    hits = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{cid}' AS cid, _row_no + 2 AS rn FROM {source} WHERE {pred}" for i, (cid, _, pred) in enumerate(cols)
    )
    return f"""SELECT '{kind}' AS type, CAST(count(*) AS BIGINT) AS affected_count, '{unit}' AS affected_unit,
  (SELECT string_agg(cid, ',' ORDER BY pos) FROM (SELECT DISTINCT pos, cid FROM ({hits}) h0)) AS affected_columns,
  (SELECT string_agg(CAST(rn AS VARCHAR), ',' ORDER BY pos, rn) FROM (
     SELECT rn, min(pos) AS pos FROM (SELECT pos, rn FROM ({hits}) h1 QUALIFY row_number() OVER (PARTITION BY pos ORDER BY rn) <= 5)
     GROUP BY rn ORDER BY min(pos), rn LIMIT 5)) AS example_rows
FROM ({hits}) h2 WHERE {keep} HAVING count(*) > 0"""


_IDS = [f"column_{i + 1}" for i in range(7)]
_DUP_ORDERS = f"""SELECT 'duplicate_rows' AS type, CAST(count(*) AS BIGINT) AS affected_count, 'rows' AS affected_unit, '' AS affected_columns,
  (SELECT string_agg(CAST(rn AS VARCHAR), ',' ORDER BY rn) FROM (SELECT rn FROM reps ORDER BY rn LIMIT 5)) AS example_rows FROM reps HAVING count(*) > 0"""


_ISSUES_ORDERS = " UNION ALL ".join([
    s_issue("missing_values", _O, [(i, c, s_missing(c)) for i, c in zip(_IDS, UPLOAD_COLUMNS)], "cells"),
    _DUP_ORDERS,
    s_issue("whitespace", _O, [(i, c, f"{c} <> trim({c})") for i, c in zip(_IDS, UPLOAD_COLUMNS)], "values"),
    "SELECT 'messy_column_names', CAST(1 AS BIGINT), 'columns', 'column_1', ''",
    s_issue("numeric_text", _O, [("column_4", "amount", s_numeric("amount"))], "values"),
    s_issue("inconsistent_dates", _O, [("column_5", "order_date", f"({s_layout('order_date')}) IS NOT NULL")], "values"),
])
_REPS = f"reps AS (SELECT _row_no + 2 AS rn FROM {_O} QUALIFY row_number() OVER (PARTITION BY {_ALL} ORDER BY _row_no) > 1)"


@query("issues_orders", _ISSUES_ORDERS, (_O,), _REPS)
def issues_orders(spark, sf):
    return _shown_issues(profile.profile_table(_uploaded_orders(spark, sf)).issues())


def _shown_issues(issues: DataFrame) -> DataFrame:
    return issues.select(
        "type", "affected_count", "affected_unit",
        F.array_join("affected_columns", ",").alias("affected_columns"),
        F.array_join(F.col("example_rows").cast("array<string>"), ",").alias("example_rows"),
    )


_EVENT_COLUMNS = _TYPED["messy_events"]


@query(
    "issues_events",
    " UNION ALL ".join([
        s_issue("missing_values", _EV, [(c, c, s_missing(c)) for c in _EVENT_COLUMNS], "cells"),
        s_issue("numeric_text", _EV, [("value_text", "value_text", s_numeric("value_text"))], "values"),
        "SELECT 'empty_columns', CAST(1 AS BIGINT), 'columns', 'note', ''",
    ]),
    (_EV,),
)
def issues_events(spark, sf):
    return _shown_issues(profile.profile_table(messy.messy_events(spark, sf)).issues())


_DOC_COLS = ["text", "lang", "source"]


@query(
    "issues_documents",
    " UNION ALL ".join([
        s_issue("whitespace", "d", [(c, c, f"{c} <> trim({c}, ' ' || chr(9) || chr(10) || chr(13))") for c in _DOC_COLS], "values"),
        """SELECT 'duplicate_rows', CAST(count(*) AS BIGINT), 'rows', '', (SELECT string_agg(CAST(rn AS VARCHAR), ',' ORDER BY rn) FROM (SELECT rn FROM reps ORDER BY rn LIMIT 5)) FROM reps HAVING count(*) > 0""",
    ]),
    (),
    "d AS (SELECT text, lang, source, doc_id AS _row_no FROM documents), reps AS (SELECT _row_no + 2 AS rn FROM d QUALIFY row_number() OVER (PARTITION BY text, lang, source ORDER BY _row_no) > 1)",
)
def issues_documents(spark, sf):
    d = table(spark, sf, "documents").select(*_DOC_COLS, F.col("doc_id").alias(ROW_NO))
    return _shown_issues(profile.profile_table(d).issues())


@query(
    "profile_lineitem",
    "SELECT 'l_orderkey' AS name, count(*) AS rows, CAST(0 AS BIGINT) AS missing, count(*) AS numeric_cells FROM lineitem "
    "UNION ALL SELECT 'l_quantity', count(*), 0, count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', count(*), 0, count(*) FROM lineitem "
    "UNION ALL SELECT 'l_discount', count(*), 0, count(*) FROM lineitem UNION ALL SELECT 'l_returnflag', count(*), 0, 0 FROM lineitem "
    "UNION ALL SELECT 'l_linestatus', count(*), 0, 0 FROM lineitem UNION ALL SELECT 'l_shipdate', count(*), 0, 0 FROM lineitem",
)
def profile_lineitem(spark, sf):
    l = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    return profile.column_counters(l).select("name", "rows", "missing", F.col("numeric").alias("numeric_cells"))


@query(
    "inspect_table",
    f"""SELECT count(*) AS row_count, CAST(7 AS BIGINT) AS column_count, {s_count(s_missing('city'))} AS missing_city,
  {s_count(s_missing('state'))} AS missing_state, {_REPEATS} AS duplicate_key_count FROM {_O}""",
    (_O,),
)
def inspect_table(spark, sf):
    t = profile.inspect_table(messy.messy_orders(spark, sf), ["order_id"])
    return t.select(
        "row_count", "column_count", F.col("missing_by_column")["city"].alias("missing_city"),
        F.col("missing_by_column")["state"].alias("missing_state"), "duplicate_key_count",
    )


@query(
    "inspect_column",
    f"""SELECT 'city' AS "column", {s_count(s_missing('city'))} AS missing_count, count(DISTINCT coalesce(city, '<null>')) AS distinct_count,
  (SELECT string_agg(v, '|' ORDER BY first) FROM (SELECT coalesce(city, '') AS v, min(_row_no) AS first FROM {_O} GROUP BY city ORDER BY first LIMIT 5)) AS unique_sample,
  'UNKNOWN' AS recommended_fill FROM {_O}""",
    (_O,),
)
def inspect_column(spark, sf):
    c = rulepack.inspect_pack_column(messy.messy_orders(spark, sf), packs.ORDERS, "city")
    return c.select("column", "missing_count", "distinct_count", F.array_join("unique_sample", "|").alias("unique_sample"), "recommended_fill")


@query("duplicate_key_count", f"SELECT {_REPEATS} AS duplicate_count", (_O,))
def duplicate_key_count(spark, sf):
    return rows.duplicate_key_count(messy.messy_orders(spark, sf), ["order_id"])


@query(
    "table_summary",
    f"SELECT count(*) AS row_count, CAST(7 AS BIGINT) AS column_count, {_MISSING_ALL} AS missing_required_cells, {_REPEATS} AS duplicate_count FROM {_O}",
    (_O,),
)
def table_summary(spark, sf):
    return profile.table_summary(messy.messy_orders(spark, sf), UPLOAD_COLUMNS, ["order_id"])


@query(
    "completeness",
    f"SELECT round(1 - ({_MISSING_ALL}) / (count(*) * 7.0), 9) AS completeness FROM {_O}", (_O,),
)
def completeness(spark, sf):
    return profile.completeness_score(messy.messy_orders(spark, sf), UPLOAD_COLUMNS).select(F.round("completeness", 9).alias("completeness"))


@query(
    "formula_warning",
    """SELECT 'documents' AS source, CAST(count(*) FILTER (WHERE text[1] IN ('=', '+', '-', '@')) AS BIGINT) AS affected_count FROM documents
UNION ALL SELECT 'orders', CAST(count(*) FILTER (WHERE k % 5 = 0) + count(*) FILTER (WHERE k % 7 = 0) AS BIGINT) FROM (SELECT o_orderkey AS k FROM orders)""",
)
def formula_warning(spark, sf):
    d = profile.formula_like_count(table(spark, sf, "documents").select("text", "lang", "source"))
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("=SUM(A"), F.col("o_orderkey").cast("string"), F.lit(")"))).otherwise("x").alias("a"),
        F.when(F.col("o_orderkey") % 7 == 0, "@now").otherwise(" =1").alias("b"),
    )
    return d.select(F.lit("documents").alias("source"), "affected_count").unionByName(
        profile.formula_like_count(o).select(F.lit("orders").alias("source"), "affected_count")
    )


# --- Upload checks (VA-11..15) and suggestions (GV-3) --------------------------------------


_FORMULAS = " + ".join(s_count(f"{c}[1] IN ('=', '+', '-', '@')") for c in UPLOAD_COLUMNS)
_UPLOAD_CHECKS = f"""
{_REPS},
issues AS ({_ISSUES_ORDERS}), formulas AS (SELECT {_FORMULAS} AS n FROM {_O}),
upload_checks AS (
  SELECT 'required_columns' AS check_id, 'failed' AS status, 'error' AS severity,
         {s_count(s_missing('city'))} + {s_count(s_missing('state'))} AS affected_count FROM {_O}
  UNION ALL SELECT 'remaining_issues', CASE WHEN count(*) > 0 THEN 'warning' ELSE 'passed' END, CASE WHEN count(*) > 0 THEN 'warning' ELSE 'info' END, count(*) FROM issues
  UNION ALL SELECT 'download_warnings', CASE WHEN n > 0 THEN 'warning' ELSE 'passed' END, CASE WHEN n > 0 THEN 'warning' ELSE 'info' END, n FROM formulas
)"""


def _validation(spark, sf):
    return validate.validate_table(profile.profile_table(_uploaded_orders(spark, sf)), ["column_1", "column_6", "column_7"], revision=3)


@query("upload_checks", "SELECT check_id, status, severity, CAST(affected_count AS BIGINT) AS affected_count FROM upload_checks", (_O,), _UPLOAD_CHECKS)
def upload_checks(spark, sf):
    return _validation(spark, sf).checks().select("check_id", "status", "severity", "affected_count")


@query(
    "upload_formula_checks",
    f"""SELECT 'download_warnings' AS check_id, CASE WHEN n > 0 THEN 'warning' ELSE 'passed' END AS status, CASE WHEN n > 0 THEN 'warning' ELSE 'info' END AS severity,
  CAST(n AS BIGINT) AS affected_count, n || ' cells may run as a formula.' AS message FROM (SELECT {_FORMULAS} AS n FROM marked)""",
    (_O,), f"marked AS (SELECT * REPLACE (CASE WHEN _row_no % 7 = 0 THEN '=' || city ELSE city END AS city, CASE WHEN _row_no % 11 = 0 THEN '@' || state ELSE state END AS state) FROM {_O})",
)
def upload_formula_checks(spark, sf):
    """Cells that a spreadsheet would run: the warning of the download."""
    def led(c: str, sign: str, every: int):
        return F.when(F.col(ROW_NO) % every == 0, F.concat(F.lit(sign), c)).otherwise(F.col(c)).alias(c)

    marked = messy.messy_orders(spark, sf).withColumns({"city": led("city", "=", 7), "state": led("state", "@", 11)})
    checks = validate.validate_table(profile.profile_table(marked)).checks().where("check_id = 'download_warnings'")
    return checks.select("check_id", "status", "severity", "affected_count", "message")


_LINE_NUMBERS = rulepack.RulePack(
    name="line items", source_system="shop", expected_columns=("quantity", "price", "part"), required_columns=(), primary_key=(),
    cast_columns={"quantity": "int", "price": "float", "part": "float", "gone": "float"},
    validation_rules={"cast_columns_numeric_non_negative": "Numbers are zero or more."},
)


@query(
    "checks_cast_columns",
    """SELECT t AS kind, CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END AS status, CAST(n AS BIGINT) AS failed_count FROM (
  SELECT 'numbers' AS t, count(*) FILTER (WHERE l_linenumber % 3 = 0) + count(*) FILTER (WHERE l_linenumber = 2) AS n FROM lineitem
  UNION ALL SELECT 'text', count(*) FILTER (WHERE l_linenumber % 3 = 0) + count(*) FILTER (WHERE l_linenumber = 2) + count(*) FROM lineitem
  UNION ALL SELECT 'clean', 0)""",
)
def checks_cast_columns(spark, sf):
    """VA-8 on cells that are missing, below zero, and text where a number is due."""
    l = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    clean = l.select(F.col("l_quantity").cast("int").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_partkey").alias("part"), n.alias("n"))
    numbers_ = clean.withColumns({"quantity": F.when(F.col("n") % 3 != 0, F.col("quantity")), "price": F.when(F.col("n") == 2, -F.col("price")).otherwise(F.col("price"))})
    out = None
    for kind, df in (("clean", clean), ("numbers", numbers_), ("text", numbers_.withColumn("part", F.col("part").cast("string")))):
        part = rulepack.run_checks(df.drop("n"), _LINE_NUMBERS).select(F.lit(kind).alias("kind"), "status", "failed_count")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "upload_rollup",
    """SELECT CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' ELSE 'passed' END AS status, CAST(3 AS INTEGER) AS revision,
  count(*) FILTER (WHERE status = 'failed') AS errors, count(*) FILTER (WHERE status = 'warning') AS warnings, count(*) FILTER (WHERE status = 'passed') AS passed FROM upload_checks""",
    (_O,), _UPLOAD_CHECKS,
)
def upload_rollup(spark, sf):
    return _validation(spark, sf).rollup().select("status", "revision", "errors", "warnings", "passed")


@query(
    "suggest_fixes",
    f"""SELECT * FROM (
  SELECT 'missing_values' AS issue_type, '{{"column_id": "column_6", "strategy": "most_common", "type": "fill_missing", "value": null}}' AS action, 'Fill missing cells' AS title WHERE (SELECT {s_count(s_missing('city'))} FROM {_O}) > 0
  UNION ALL SELECT 'duplicate_rows', '{{"keep": "first", "type": "drop_duplicates"}}', 'Drop repeated rows' WHERE (SELECT count(*) FROM {_O}) > (SELECT count(*) FROM (SELECT DISTINCT {_ALL} FROM {_O}))
  UNION ALL SELECT 'whitespace', '{{"column_ids": ["column_3", "column_4", "column_6", "column_7"], "type": "trim_whitespace"}}', 'Trim white space' WHERE (SELECT {s_count('status <> trim(status)')} FROM {_O}) > 0
  UNION ALL SELECT 'messy_column_names', '{{"column_id": "column_1", "new_name": "order_id", "type": "rename_column"}}', 'Rename the column'
  UNION ALL SELECT 'numeric_text', '{{"column_id": "column_4", "target_type": "decimal", "type": "convert_numeric"}}', 'Convert to numbers' WHERE (SELECT {s_count(s_numeric('amount'))} * 1.0 / count(*) FROM {_O}) >= 0.8
  UNION ALL SELECT 'inconsistent_dates', '{{"column_id": "column_5", "date_order": "day_first", "output_format": "YYYY-MM-DD", "type": "standardize_date"}}', 'Use one date layout' WHERE (SELECT count(DISTINCT {s_layout('order_date')}) FROM {_O}) >= 2)""",
    (_O,),
)
def suggest_fixes(spark, sf):
    return suggestions(profile.profile_table(_uploaded_orders(spark, sf))).select("issue_type", "action", "title")


# --- Compare (CM-1..8) ---------------------------------------------------------------------


def _staged_orders(spark, sf):
    """The clean orders, made once for both sides of a comparison."""
    return stage(_clean_orders(spark, sf), "clean-orders")


def _expected(clean):
    """The right orders, but every 17th is missing and every 13th has another amount."""
    return clean.where(F.substring("order_id", 5, 9).cast("bigint") % 17 != 0).withColumn(
        "amount", F.col("amount") + F.when(F.substring("order_id", 5, 9).cast("bigint") % 13 == 0, 0.5).otherwise(0.0)
    )


_EXPECTED_SQL = CLEAN_ORDERS_SQL + """,
expected AS (
  SELECT * REPLACE (amount + CASE WHEN CAST(substr(order_id, 5) AS BIGINT) % 13 = 0 THEN 0.5 ELSE 0.0 END AS amount)
  FROM clean_orders WHERE CAST(substr(order_id, 5) AS BIGINT) % 17 <> 0
)"""
_GRADED = ", ".join(UPLOAD_COLUMNS)
_SAME = " + ".join(
    f"(coalesce(abs(a.{c} - b.{c}) <= 1e-6, a.{c} IS NULL AND b.{c} IS NULL))::INT" if c == "amount"
    else f"(coalesce(a.{c}, '') = coalesce(b.{c}, ''))::INT"
    for c in UPLOAD_COLUMNS
)
_POSITIONAL = f"""
a AS (SELECT {_GRADED}, row_number() OVER (ORDER BY order_id) AS p FROM clean_orders),
b AS (SELECT {_GRADED}, row_number() OVER (ORDER BY order_id) AS p FROM expected)"""


@query(
    "grade_positional",
    f"""SELECT CAST(sum({_SAME}) AS BIGINT) AS matches, CAST(count(*) * 7 AS BIGINT) AS cells,
  round(least(greatest(sum({_SAME}) / (count(*) * 7.0), 0.01), 0.99), 6) AS score FROM a FULL JOIN b USING (p)""",
    (_O,), _EXPECTED_SQL + "," + _POSITIONAL,
)
def grade_positional(spark, sf):
    clean = _staged_orders(spark, sf)
    return rulepack.grade(clean, _expected(clean), packs.ORDERS).select("matches", "cells", "score")


@query(
    "grade_source_order",
    f"""SELECT CAST(sum((coalesce(a.status, '') = coalesce(b.status, ''))::INT + (coalesce(a.city, '') = coalesce(b.city, ''))::INT) AS BIGINT) AS matches,
  CAST(count(*) * 2 AS BIGINT) AS cells
FROM (SELECT status, city, row_number() OVER (ORDER BY _row_no) AS p FROM {_O}) a
FULL JOIN (SELECT trim(status) AS status, city, row_number() OVER (ORDER BY _row_no) AS p FROM {_O} WHERE _row_no % 20 <> 1) b USING (p)""",
    (_O,),
)
def grade_source_order(spark, sf):
    o = messy.messy_orders(spark, sf).select("status", "city", ROW_NO)
    other = cells.trim_whitespace(o, ["status"]).where(F.col(ROW_NO) % 20 != 1)
    return compare.match_ratio(o, other, ["status", "city"], None).select("matches", "cells")


_DIFF_SQL = """
d AS (
  SELECT coalesce(a.order_id, b.order_id) AS order_id,
         CASE WHEN b.order_id IS NULL THEN 'new' WHEN a.order_id IS NULL THEN 'removed' WHEN a.amount <> b.amount THEN 'changed' ELSE 'unchanged' END AS status
  FROM clean_orders a FULL JOIN expected b ON a.order_id = b.order_id
)"""


@query(
    "keyed_diff",
    """SELECT order_id, status, CASE status WHEN 'changed' THEN 'amount' WHEN 'new' THEN 'order_id,customer_name,status,amount,order_date,city,state' ELSE '' END AS changed_columns FROM d""",
    (_O,), _EXPECTED_SQL + "," + _DIFF_SQL,
)
def keyed_diff(spark, sf):
    clean = _staged_orders(spark, sf)
    d = compare.keyed_diff(clean, _expected(clean), ["order_id"])
    return d.select("order_id", "status", F.array_join("changed_columns", ",").alias("changed_columns"))


@query(
    "keyed_diff_removed",
    "SELECT status, count(*) AS rows FROM (SELECT CASE status WHEN 'new' THEN 'removed' ELSE status END AS status FROM d) GROUP BY status",
    (_O,), _EXPECTED_SQL + "," + _DIFF_SQL,
)
def keyed_diff_removed(spark, sf):
    clean = _staged_orders(spark, sf)
    return compare.diff_summary(compare.keyed_diff(_expected(clean), clean, ["order_id"]))


_FOOT_SQL = f"""
a AS (SELECT {_ALL}, row_number() OVER (ORDER BY _row_no) AS p FROM {_O}),
b AS (SELECT {_ALL}, row_number() OVER (ORDER BY rn) AS p FROM (SELECT {_ALL}, min(_row_no) AS rn FROM {_O} GROUP BY ALL))"""
_FOOT_ANY = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in UPLOAD_COLUMNS)


@query(
    "change_footprint",
    f"""SELECT count(*) FILTER (WHERE {_FOOT_ANY}) AS row_count, {', '.join(f'count(*) FILTER (WHERE a.{c} IS DISTINCT FROM b.{c}) AS changed_{c}' for c in ('status', 'city', 'order_id'))}
FROM a FULL JOIN b USING (p)""",
    (_O,), _FOOT_SQL,
)
def change_footprint(spark, sf):
    o = messy.messy_orders(spark, sf)
    f = compare.change_footprint(o, rows.drop_duplicates(o))
    return f.select(
        "row_count",
        *[F.coalesce(F.try_element_at("changed_cells", F.lit(c)), F.lit(0)).cast("bigint").alias(f"changed_{c}") for c in ("status", "city", "order_id")],
    )


# --- Plans and audit (GV-6, GV-8) ----------------------------------------------------------


def _customer_plan(spark, sf) -> TablePlan:
    c = from_frame(messy.messy_customers(spark, sf))
    return (
        TablePlan(c)
        .add(A.TrimWhitespace(("column_2", "column_3", "column_4")))
        .add(A.StandardizeDate("column_5", "day_first"))
        .add(A.FillMissing("column_6", "explicit", "none"))
        .add(A.DropDuplicates("first"))
    )


@query(
    "plan_audit",
    """SELECT 'chg-001' AS change_id, 'trim_whitespace' AS action_type, 'low' AS risk,
  CAST(sum((full_name <> trim(full_name))::INT + (email <> trim(email))::INT + (customer_segment <> trim(customer_segment))::INT) AS BIGINT) AS affected_count, CAST(2 AS INTEGER) AS revision FROM messy_customers
UNION ALL SELECT 'chg-002', 'standardize_date', 'high', count(*), 3 FROM messy_customers
UNION ALL SELECT 'chg-003', 'fill_missing', 'high', count(*) FILTER (WHERE phone IS NULL), 4 FROM messy_customers
UNION ALL SELECT 'chg-004', 'drop_duplicates', 'high', 0, 5""",
    ("messy_customers",),
)
def plan_audit(spark, sf):
    return _customer_plan(spark, sf).audit().select("change_id", "action_type", "risk", "affected_count", "revision")


@query(
    "plan_undo",
    f"SELECT customer_id AS column_1, trim(email) AS column_3, {s_day_first('signup_date')} AS column_5, phone AS column_6 FROM messy_customers",
    ("messy_customers",),
)
def plan_undo(spark, sf):
    return _customer_plan(spark, sf).undo().undo().current().select("column_1", "column_3", "column_5", "column_6")


@query(
    "pack_audit_metrics",
    f"""SELECT 0 AS step, 'strip_whitespace' AS action_type, CAST({' + '.join(s_count(f'{c} <> trim({c})') for c in UPLOAD_COLUMNS)} AS BIGINT) AS affected_count FROM {_O}
UNION ALL SELECT 1, 'replace_values', {s_count(f'trim(status) <> {_STATUS}')} FROM {_O}
UNION ALL SELECT 2, 'standardize_date', {s_count(f"order_date <> {s_canon('order_date')}")} FROM {_O}
UNION ALL SELECT 3, 'fill_missing', {s_count(s_missing('city'))} + {s_count(s_missing('state'))} FROM {_O}
UNION ALL SELECT 4, 'cast_dtype', count(*) FROM {_O}
UNION ALL SELECT 5, 'drop_duplicates', {_REPEATS}""",
    (_O,),
)
def pack_audit_metrics(spark, sf):
    o = messy.messy_orders(spark, sf)
    return plan_metrics(o, rulepack.compile_pack(packs.ORDERS, data_columns(o))).select("step", "action_type", "affected_count")


@query(
    "pack_step_reports",
    f"""SELECT 0 AS step, 'replace_values' AS action_type, {s_count("lower(trim(status)) = 'canceled'")} AS affected_row_count,
  count(*) AS rows_before, count(*) AS rows_after FROM {_O}
UNION ALL SELECT 1, 'drop_duplicates', count(*) - count(DISTINCT order_id), count(*), count(DISTINCT order_id) FROM {_O}""",
    (_O,),
)
def pack_step_reports(spark, sf):
    o = messy.messy_orders(spark, sf)
    steps = [A.ReplaceValues("status", {"canceled": "cancelled"}), A.KeepBest(("order_id",), ("city",))]
    return step_reports(o, steps, UPLOAD_COLUMNS, ["order_id"]).select(
        "step", "action_type", "affected_row_count",
        F.col("before_summary.row_count").alias("rows_before"), F.col("after_summary.row_count").alias("rows_after"),
    )


# --- Sources and sinks (SR-1..8, SK-1..2) --------------------------------------------------


@query(
    "csv_round_trip",
    f"""SELECT {', '.join(f"coalesce({c}, '') AS {c}" for c in UPLOAD_COLUMNS)}, row_number() OVER (ORDER BY _row_no) - 1 AS row_no FROM {_O}""",
    (_O,),
)
def csv_round_trip(spark, sf):
    path = export.write_csv(_uploaded_orders(spark, sf), staging_path(spark, "csv-export"))
    back = csv_source.read_csv(spark, path)
    return back.toDF(*UPLOAD_COLUMNS, "row_no")


@query("csv_quoted_lines", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, lang, source FROM documents")
def csv_quoted_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", F.col("doc_id").alias(ROW_NO))
    back = csv_source.read_named_csv(spark, export.write_csv(d, staging_path(spark, "csv-export")))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "source")


@query(
    "gold_csv",
    "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, regexp_replace(CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR), '\\.?0+$', '') AS l_quantity, "
    "regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), '\\.?0+$', '') AS l_extendedprice, l_returnflag FROM lineitem",
)
def gold_csv(spark, sf):
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return csv_source.read_gold_csv(spark, export.write_csv(l, staging_path(spark, "csv-export"), in_order=False)).drop(ROW_NO)


@query(
    "validated_bundle",
    f"""SELECT 'cleaned' AS part, count(*) AS entries FROM {_O} UNION ALL SELECT 'checks', 3 UNION ALL SELECT 'summary', 1 UNION ALL SELECT 'audit', 1""",
    (_O,),
)
def validated_bundle(spark, sf):
    plan = TablePlan(_uploaded_orders(spark, sf)).add(A.TrimWhitespace(("column_3",)))
    current = plan.current()
    outcome = validate.validate_table(profile.profile_table(current), ["column_1"], plan.revision)
    path = export.write_validated_bundle(current, outcome, plan.audit(), staging_path(spark, "bundle"), plan.revision)
    parts = {
        "cleaned": csv_source.read_csv(spark, f"{path}/cleaned"),
        "checks": spark.read.json(f"{path}/validation_report/checks"),
        "summary": spark.read.json(f"{path}/validation_report/summary"),
        "audit": spark.read.json(f"{path}/audit_log"),
    }
    out = None
    for name, df in parts.items():
        part = df.groupBy().count().select(F.lit(name).alias("part"), F.col("count").alias("entries"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "bundle_cleaned",
    "SELECT " + ", ".join(f"coalesce({'trim(status)' if c == 'status' else c}, '') AS {c}" for c in UPLOAD_COLUMNS) + f", row_number() OVER (ORDER BY _row_no) - 1 AS row_no FROM {_O}", (_O,),
)
def bundle_cleaned(spark, sf):
    """The bundle's table, cell by cell and in order."""
    plan = TablePlan(_uploaded_orders(spark, sf)).add(A.TrimWhitespace(("column_3",)))
    outcome = validate.validate_table(profile.profile_table(plan.current()), ["column_1"], plan.revision)
    path = export.write_validated_bundle(plan.current(), outcome, plan.audit(), staging_path(spark, "bundle"), plan.revision)
    return csv_source.read_csv(spark, f"{path}/cleaned").toDF(*UPLOAD_COLUMNS, ROW_NO).withColumnRenamed(ROW_NO, "row_no")


@query("pack_export", "SELECT order_id, customer_name, status, amount, order_date, city, state FROM clean_orders", (_O,), CLEAN_ORDERS_SQL)
def pack_export(spark, sf):
    o = messy.messy_orders(spark, sf)
    clean = rulepack.clean(o, packs.ORDERS)
    audit = plan_metrics(o, rulepack.compile_pack(packs.ORDERS, data_columns(o)))
    path = export.export_pack(clean, packs.ORDERS, audit, staging_path(spark, "pack-export"))
    return export.read_export(spark, path)


@query(
    "pack_report",
    f"""SELECT round(least(greatest(sum({_SAME}) / (count(*) * 7.0), 0.01), 0.99), 6) AS quality_index FROM a FULL JOIN b USING (p)""",
    (_O,), _EXPECTED_SQL + "," + _POSITIONAL,
)
def pack_report(spark, sf):
    """The quality index that the export writes beside the table."""
    o = messy.messy_orders(spark, sf)
    audit = plan_metrics(o, rulepack.compile_pack(packs.ORDERS, data_columns(o)))
    clean = _staged_orders(spark, sf)
    path = export.export_pack(clean, packs.ORDERS, audit, staging_path(spark, "pack-report"), gold=_expected(clean))
    return spark.read.json(f"{path}/quality_report").select("quality_index")


@query(
    "publish_table",
    "SELECT order_id, customer_name, status, amount, order_date, city, state, CAST(NULL AS VARCHAR) AS approved_by FROM clean_orders",
    (_O,), CLEAN_ORDERS_SQL,
)
def publish_table(spark, sf):
    """Columns out of name order, one of them null throughout, through an export and a catalog table."""
    o = messy.messy_orders(spark, sf)
    clean = rulepack.clean(o, packs.ORDERS).withColumn("approved_by", F.lit(None).cast("string"))
    target = staging_path(spark, "publish")
    export.write_export(clean.drop(ROW_NO), target)
    export.publish(spark, target, "published_orders", "overwrite")
    back = spark.table("published_orders")
    if back.columns != data_columns(clean):
        raise ValueError(f"columns are out of order: {back.columns}")
    return back


# --- Scalar functions (FN-*) ---------------------------------------------------------------


@query(
    "fn_text",
    f"""SELECT customer_id, {s_missing('phone')} AS missing, full_name <> trim(full_name) AS padded, {s_title('full_name')} AS title,
  regexp_full_match(trim(email), '[^@ ]+@[^@ ]+\\.[^@ ]+') AS email_ok, lower(trim(customer_segment)) AS folded,
  '{{"a":' || coalesce('"' || phone || '"', 'null') || ',"b":"' || customer_segment || '"}}' AS json,
  coalesce(phone, '') AS key_text, 1 + (phone IS NOT NULL)::INT AS present
FROM messy_customers""",
    ("messy_customers",),
)
def fn_text(spark, sf):
    c = messy.messy_customers(spark, sf)
    col = F.col
    return c.select(
        "customer_id",
        text.is_missing(col("phone")).alias("missing"),
        text.is_padded(col("full_name")).alias("padded"),
        text.title_case(col("full_name")).alias("title"),
        text.looks_like_email(col("email")).alias("email_ok"),
        text.fold_key(col("customer_segment")).alias("folded"),
        text.stable_json([("b", col("customer_segment")), ("a", col("phone"))]).alias("json"),
        text.canonical_key([(col("phone"), None)])["k0"].alias("key_text"),
        text.count_present([(col("phone"), None), (col("email"), None)]).alias("present"),
    )


@query(
    "fn_numbers",
    f"""SELECT _row_no AS row_no, {s_bare('amount')} AS numeric_text, CAST({s_bare('amount')} AS DOUBLE) AS value,
  CAST(trunc(CAST({s_bare('amount')} AS DOUBLE)) AS BIGINT) AS whole, {s_numeric('amount')} AS looks_numeric,
  regexp_full_match({s_bare('order_id')}, '[+-]?0[0-9]+') AS leading_zero FROM {_O}""",
    (_O,),
)
def fn_numbers(spark, sf):
    o = messy.messy_orders(spark, sf)
    return o.select(
        F.col(ROW_NO).alias("row_no"),
        numbers.numeric_text(F.col("amount")).alias("numeric_text"),
        numbers.numeric_value(F.col("amount")).alias("value"),
        numbers.coerce_int(F.translate("amount", "$", "")).alias("whole"),
        numbers.is_numeric_looking(F.col("amount")).alias("looks_numeric"),
        numbers.has_leading_zero(F.col("order_id")).alias("leading_zero"),
    )


@query(
    "fn_stringify",
    """SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(CAST(CAST(l_discount AS DECIMAL(12,2)) AS VARCHAR), '\\.?0+$', '') AS discount,
  regexp_replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR), '\\.?0+$', '') AS price, CAST(l_linenumber AS VARCHAR) AS line FROM lineitem""",
)
def fn_stringify(spark, sf):
    l = table(spark, sf, "lineitem")

    def shown(c: str):
        return text.stringify(F.col(c), l.schema[c].dataType)

    return l.select(
        "l_orderkey", "l_linenumber", "l_partkey", shown("l_discount").alias("discount"),
        shown("l_extendedprice").alias("price"), shown("l_linenumber").alias("line"),
    )


@query(
    "fn_dates",
    f"""SELECT _row_no AS row_no, {s_canon('order_date')} AS canonical, {s_layout('order_date')} AS layout,
  order_date = {s_canon('order_date')} AS is_canonical, {s_day_first('order_date')} AS day_first,
  strftime(coalesce(try_strptime(order_date, ['%Y/%m/%d', '%Y-%m-%d']), try_strptime(order_date, ['%m/%d/%Y', '%m-%d-%Y']), try_strptime(order_date, ['%d/%m/%Y', '%d-%m-%Y'])), '%d/%m/%Y') AS month_first FROM {_O}""",
    (_O,),
)
def fn_dates(spark, sf):
    d = F.col("order_date")
    return messy.messy_orders(spark, sf).select(
        F.col(ROW_NO).alias("row_no"),
        dates.canonical_date(d, False).alias("canonical"),
        dates.date_layout(d).alias("layout"),
        dates.is_canonical_date(d, False).alias("is_canonical"),
        dates.format_free_date(d, True, "YYYY-MM-DD").alias("day_first"),
        dates.format_free_date(d, False, "DD/MM/YYYY").alias("month_first"),
    )
