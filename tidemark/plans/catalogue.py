"""One query for each operator over the shared test tables, and the same in SQL.

Times are returned as text, since the high date lies beyond what data frames of other libraries hold.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import capped_ratio, date_key, end_of_day, from_date_key, iso_weekday, low, seconds_between, surrogate_key, timestamp_text, unknown_key
from tidemark.functions import checksum
from tidemark.operators import checks, dimensional, history, ranking
from tidemark.operators.history import asc, desc
from tidemark.plans import Project, write_audit_publish
from tidemark.session import shared_folder, small_frame
from tidemark.sources import bronze
from tidemark.sources.tables import Backfill, Catalog, CatalogError
from tidemark.streaming import drain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
HIGH = "TIMESTAMP '9999-12-31 23:59:59.999999'"
UNKNOWN = "md5('-1')"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(lambda t: spark.read.parquet(f"{d}/{t}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def money(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)")


def texts(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: timestamp_text(c) for c in cols})


# versions of users, from their events of other kinds than the facts'

STATES = ["signup", "error", "view"]
USER_VERSIONS = f"""
e AS (SELECT user_id, ts, event_type AS tier FROM events WHERE event_type IN ('signup', 'error', 'view')),
c AS (SELECT *, lag(tier) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM e),
v AS (SELECT user_id, tier, ts AS effective_from, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts), {HIGH}) AS effective_to,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) AS INTEGER) AS scd_version, md5(user_id::VARCHAR || '-' || {TEXT.format("ts")}) AS sk FROM c WHERE was IS NULL OR was <> tier)
"""


def user_versions(t: Callable) -> DataFrame:
    e = t("events").where(F.col("event_type").isin(STATES)).select("user_id", "ts", "event_id", F.col("event_type").alias("tier"))
    return history.scd2(e, "user_id", "ts", ["tier"], desc("event_id"))


@query(f"""WITH {USER_VERSIONS} SELECT coalesce(v.tier, 'Unknown') AS tier, f.event_type, count(*) AS n_facts, count(DISTINCT f.user_id) AS n_users
FROM events f LEFT JOIN v ON f.user_id = v.user_id AND f.ts >= v.effective_from AND f.ts < v.effective_to
WHERE f.event_type IN ('purchase', 'click') GROUP BY ALL""")
def pit_facts_by_tier(t):
    facts = t("events").where(F.col("event_type").isin("purchase", "click")).select("user_id", "ts", "event_type")
    out = history.pit_join(facts, user_versions(t), "user_id", "ts", {"tier": "tier"}, unknown={"tier": F.lit("Unknown")})
    return out.groupBy("tier", "event_type").agg(F.count("*").alias("n_facts"), F.count_distinct("user_id").alias("n_users"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_keep_latest(t):
    order = [*desc("l_shipdate"), *asc("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    return history.keep_first(t("lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def shipped(t):
    return t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def gate_rules() -> list[history.Rule]:
    return [history.Rule("no_quantity", F.col("l_quantity") <= 0), history.Rule("shipped_before_ordered", F.col("l_shipdate") < F.col("o_orderdate")), history.Rule("future", F.col("l_shipdate") > F.lit("2001-01-01").cast("timestamp_ntz"))]


@query("""SELECT CASE WHEN l_quantity <= 0 THEN 'no_quantity' WHEN l_shipdate < o_orderdate THEN 'shipped_before_ordered' WHEN l_shipdate > TIMESTAMP '2001-01-01' THEN 'future' ELSE 'clean' END AS outcome,
count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def gate_outcomes(t):
    return history.outcomes(shipped(t), gate_rules()).groupBy("outcome").agg(F.count("*").alias("n"))


REJECTED = "(l_quantity <= 0 OR l_shipdate < o_orderdate OR l_shipdate > TIMESTAMP '2001-01-01')"


@query(f"""WITH j AS (FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (
SELECT 'whole' AS gate, count(*) AS n_staged, count(*) FILTER (NOT {REJECTED}) AS n_clean, count(*) FILTER ({REJECTED}) AS n_rejected FROM j
UNION ALL SELECT 'leaking', count(*), count(*) FILTER (NOT {REJECTED} AND l_linenumber <> 2), count(*) FILTER ({REJECTED}) FROM j) SELECT * FROM n WHERE n_staged <> n_clean + n_rejected""")
def gate_conservation(t):
    """A gate that keeps all rows gives none here, one that loses some gives its counts."""
    df = shipped(t)
    clean, refused = history.accepted(df, gate_rules()), history.rejected(df, gate_rules())
    whole, leaking = history.conservation(df, clean, refused), history.conservation(df, clean.where("l_linenumber <> 2"), refused)
    return whole.select(F.lit("whole").alias("gate"), "*").unionByName(leaking.select(F.lit("leaking").alias("gate"), "*"))


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders),
c AS (SELECT *, lag(o_orderstatus) OVER w AS was FROM e WHERE rn = 1 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)),
v AS (SELECT *, coalesce(lead(o_orderdate) OVER w, {HIGH}) AS t, CAST(row_number() OVER w AS INTEGER) AS scd_version FROM c WHERE was IS NULL OR was <> o_orderstatus WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate))
SELECT o_custkey, o_orderstatus, md5(o_orderstatus) AS row_hash, {TEXT.format("o_orderdate")} AS effective_from, {TEXT.format("t")} AS effective_to, scd_version, t = {HIGH} AS is_current,
md5(o_custkey::VARCHAR || '-' || {TEXT.format("o_orderdate")}) AS customer_sk FROM v
UNION ALL SELECT -1, 'Unknown', 'Unknown', '1900-01-01 00:00:00.000000', '9999-12-31 23:59:59.999999', 1, true, {UNKNOWN}""")
def scd2_customers(t):
    o = t("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    v = history.scd2(o, "o_custkey", "o_orderdate", ["o_orderstatus"], desc("o_orderkey"), "customer_sk").drop("o_orderkey")
    return texts(history.with_unknown(v, "customer_sk", "o_custkey"), "effective_from", "effective_to")


@query(f"""WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'churned' ELSE event_type END AS status, ['basic', 'standard', 'premium'][event_id % 3 + 1] AS tier, props, event_type, value FROM events WHERE event_type IN ('signup', 'error', 'view')),
m AS (SELECT *, CASE WHEN lag(tier) OVER w IS NOT DISTINCT FROM tier THEN 0 ELSE 1 END AS mt, CASE WHEN lag(status) OVER w IS NOT DISTINCT FROM status THEN 0 ELSE 1 END AS ms FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(mt) OVER w AS st, sum(ms) OVER w AS ss FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
l AS (SELECT user_id, arg_max(tier, ts) AS current_tier, arg_max(status, ts) AS last_status, arg_max(props, ts) AS props, max(ss) AS es, arg_min(value, ts) FILTER (event_type = 'signup') AS value FROM s GROUP BY user_id),
b AS (SELECT user_id, ss AS es, min(ts) AS began FROM s GROUP BY ALL),
g AS (SELECT user_id, st, lag(tier) OVER (PARTITION BY user_id ORDER BY st) AS previous_tier FROM (SELECT user_id, st, any_value(tier) AS tier FROM s GROUP BY ALL)),
v AS (SELECT *, coalesce(lead(ts) OVER w, {HIGH}) AS t, CAST(row_number() OVER w AS INTEGER) AS scd_version FROM s WHERE mt = 1 OR ms = 1 WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT v.user_id, v.tier, v.status, {TEXT.format("v.ts")} AS effective_from, {TEXT.format("v.t")} AS effective_to, v.scd_version, g.previous_tier, l.current_tier,
CASE WHEN l.last_status = 'churned' THEN {TEXT.format("b.began")} END AS churned_at, l.props, l.value, v.t = {HIGH} AS is_current, md5(v.user_id::VARCHAR || '-' || {TEXT.format("v.ts")}) AS sk
FROM v JOIN l USING (user_id) JOIN g ON g.user_id = v.user_id AND g.st = v.st JOIN b ON b.user_id = v.user_id AND b.es = l.es""")
def scd6_users(t):
    tier = F.element_at(F.array(*map(F.lit, ("basic", "standard", "premium"))), (F.col("event_id") % 3 + 1).cast("int"))
    e = t("events").where(F.col("event_type").isin(STATES)).select("user_id", "ts", "event_id", "event_type", F.col("event_type").alias("status"), tier.alias("tier"), "props", "value")
    v = history.scd6(e, "user_id", "ts", "tier", "status", ["props"], desc("event_id"), ["error"], ("value", F.col("event_type") == "signup"))
    return texts(v.drop("row_hash"), "effective_from", "effective_to", "churned_at")


@query(f"""WITH {USER_VERSIONS}, f AS (SELECT event_id, user_id, date_trunc('second', ts) AS at FROM events WHERE event_type IN ('signup', 'error', 'view'))
SELECT f.event_id, arg_max(v.sk, v.effective_from) AS user_sk FROM f LEFT JOIN v ON f.user_id = v.user_id AND f.at >= v.effective_from - INTERVAL 1 SECOND AND f.at < v.effective_to GROUP BY f.event_id""")
def widened_pit(t):
    f = t("events").where(F.col("event_type").isin(STATES)).select("event_id", "user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"))
    return history.wide_pit_join(f, user_versions(t), "user_id", "at", "event_id", {"sk": "user_sk"}).select("event_id", "user_sk")


@query(f"""WITH d AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0)
SELECT c_custkey, c_name, c_mktsegment, md5(c_custkey::VARCHAR || '-1900-01-01 00:00:00.000000') AS sk, false AS is_inferred FROM d
UNION ALL SELECT DISTINCT o_custkey, 'unknown', 'unknown', md5(o_custkey::VARCHAR || '-1900-01-01 00:00:00.000000'), true FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM d)
UNION ALL SELECT -1, 'Unknown', 'Unknown', {UNKNOWN}, false""")
def late_members(t):
    d = t("customer").where("c_custkey % 10 <> 0").select("c_custkey", "c_name", "c_mktsegment", low().alias("effective_from"), F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz").alias("effective_to"), F.lit(True).alias("is_current"), F.lit(1).alias("scd_version"))
    d = d.withColumn("sk", surrogate_key("c_custkey", timestamps=("effective_from",)))
    d = history.with_inferred(d, [(t("orders"), "o_custkey")], "sk", "c_custkey")
    return history.with_unknown(d, "sk", "c_custkey").select("c_custkey", "c_name", "c_mktsegment", "sk", "is_inferred")


@query("""SELECT md5(p || '-' || s || '-' || f) AS junk_sk, p AS o_orderpriority, s AS o_orderstatus, f AS l_returnflag FROM (SELECT DISTINCT o_orderpriority AS p FROM orders), (SELECT DISTINCT o_orderstatus AS s FROM orders), (SELECT DISTINCT l_returnflag AS f FROM lineitem)
UNION ALL SELECT md5('Unknown-Unknown-Unknown'), 'Unknown', 'Unknown', 'Unknown'""")
def junk_dimension(t):
    return dimensional.junk(shipped(t).select("o_orderpriority", "o_orderstatus", "l_returnflag"), ["o_orderpriority", "o_orderstatus", "l_returnflag"], "junk_sk", dict.fromkeys(("o_orderpriority", "o_orderstatus", "l_returnflag"), "Unknown"))


CALENDAR = """
d AS (SELECT CAST(r AS DATE) AS d FROM range(DATE '2023-01-01', DATE '2028-01-01', INTERVAL 1 DAY) t(r)),
k AS (SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS date_day, CAST(isodow(d) AS INTEGER) AS day_of_week, dayname(d) AS day_name, CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofyear(d) AS INTEGER) AS day_of_year,
  CAST(week(d) AS INTEGER) AS week_of_year, CAST(month(d) AS INTEGER) AS month_number, monthname(d) AS month_name, CAST(quarter(d) AS INTEGER) AS quarter_number, CAST(year(d) AS INTEGER) AS year_number,
  isodow(d) >= 6 AS is_weekend, day(d) = 1 AS is_month_start, d = last_day(d) AS is_month_end, CAST((month(d) + 5) % 12 + 1 AS INTEGER) AS fiscal_month FROM d),
h AS (SELECT *, CAST((fiscal_month - 1) // 3 + 1 AS INTEGER) AS fiscal_quarter, CASE WHEN month_number >= 7 THEN year_number + 1 ELSE year_number END AS fiscal_year, (day_of_month - 1) // 7 + 1 AS nth FROM k),
c AS (SELECT * EXCLUDE (nth), CASE WHEN month_number = 1 AND day_of_month = 1 THEN 'New Year''s Day' WHEN month_number = 1 AND day_of_week = 1 AND nth = 3 THEN 'Martin Luther King Jr. Day' WHEN month_number = 2 AND day_of_week = 1 AND nth = 3 THEN 'Presidents'' Day'
  WHEN month_number = 5 AND day_of_week = 1 AND day_of_month > 24 THEN 'Memorial Day' WHEN month_number = 6 AND day_of_month = 19 THEN 'Juneteenth' WHEN month_number = 7 AND day_of_month = 4 THEN 'Independence Day'
  WHEN month_number = 9 AND day_of_week = 1 AND nth = 1 THEN 'Labor Day' WHEN month_number = 10 AND day_of_week = 1 AND nth = 2 THEN 'Columbus Day' WHEN month_number = 11 AND day_of_month = 11 THEN 'Veterans Day'
  WHEN month_number = 11 AND day_of_week = 4 AND nth = 4 THEN 'Thanksgiving Day' WHEN month_number = 12 AND day_of_month = 25 THEN 'Christmas Day' END AS holiday_name FROM h)
"""


@query(f"WITH {CALENDAR} SELECT * REPLACE (strftime(date_day, '%Y-%m-%d') AS date_day), holiday_name IS NOT NULL AS is_holiday FROM c")
def calendar_dimension(t):
    spark = t("region").sparkSession
    return dimensional.calendar(spark, date(2023, 1, 1), date(2028, 1, 1)).withColumn("date_day", F.col("date_day").cast("string"))


@query(f"WITH {CALENDAR} SELECT date_key AS billing_date_key, month_name, fiscal_year FROM c")
def role_playing_date(t):
    dates = dimensional.role_view(dimensional.calendar(t("region").sparkSession, date(2023, 1, 1), date(2028, 1, 1)), "billing")
    return dates.select("billing_date_key", "month_name", "fiscal_year")


@query(f"""WITH {USER_VERSIONS}, r AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) FILTER (event_type = 'error') AS DATE) AS b FROM events GROUP BY user_id),
x AS (SELECT user_id, a, unnest(generate_series(greatest(a, DATE '2024-01-03')::TIMESTAMP, least(coalesce(b, DATE '2024-01-28'), DATE '2024-01-28')::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM r WHERE least(coalesce(b, DATE '2024-01-28'), DATE '2024-01-28') >= greatest(a, DATE '2024-01-03'))
SELECT x.user_id, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS snapshot_date_key, CAST(date_diff('day', a, d) + 1 AS INTEGER) AS tenure_days, v.tier FROM x LEFT JOIN v ON x.user_id = v.user_id
AND d + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND >= v.effective_from AND d + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND < v.effective_to""")
def periodic_snapshot(t):
    roster = t("events").groupBy("user_id").agg(F.min("ts").cast("date").alias("a"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).cast("date").alias("b"))
    out = dimensional.periodic_snapshot(roster, user_versions(t), "user_id", "a", "b", date(2024, 1, 3), date(2024, 1, 28), {"tier": "tier"})
    return out.select("user_id", "snapshot_date_key", "tenure_days", "tier")


@query("""WITH m AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS a, min(ts) FILTER (event_type = 'view') AS b, min(ts) FILTER (event_type = 'purchase') AS c FROM events WHERE event_type IN ('signup', 'view', 'purchase') GROUP BY user_id)
SELECT user_id, CAST(strftime(a, '%Y%m%d') AS INTEGER) AS signup_date_key, CAST(strftime(b, '%Y%m%d') AS INTEGER) AS view_date_key, CAST(strftime(c, '%Y%m%d') AS INTEGER) AS purchase_date_key,
CAST(round(CAST(CASE WHEN b >= a THEN date_sub('second', a, b) ELSE -date_sub('second', b, a) END AS DECIMAL(18, 6)) / 3600, 2) AS DOUBLE) AS hours_to_view,
CASE WHEN c IS NOT NULL THEN 'completed' WHEN a < TIMESTAMP '2024-02-05' - INTERVAL 30 DAY THEN 'expired' ELSE 'in_progress' END AS funnel_status FROM m""")
def accumulating_snapshot(t):
    steps = ["signup", "view", "purchase"]
    m = dimensional.milestones(t("events"), "user_id", "ts", "event_type", steps)
    out = dimensional.accumulating_snapshot(m, steps, {"hours_to_view": ("signup", "view")}, datetime(2024, 2, 5))
    return out.select("user_id", *(f"{s}_date_key" for s in steps), F.col("hours_to_view").cast("double").alias("hours_to_view"), "funnel_status")


BRIDGE = """
n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT *, CAST(round(n::DOUBLE / (sum(n) OVER (PARTITION BY l_partkey))::DOUBLE, 4) AS DECIMAL(6, 4)) AS share, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_suppkey) IS NULL AS z FROM n),
a AS (SELECT l_partkey, l_suppkey, CASE WHEN z THEN CAST(1 - sum(share) OVER (PARTITION BY l_partkey) + share AS DECIMAL(6, 4)) ELSE share END AS allocation_weight FROM s)
"""


def part_suppliers(t):
    n = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return dimensional.weights(n, "l_partkey", "l_suppkey", "n").drop("n")


@query(f"WITH {BRIDGE} SELECT l_partkey, l_suppkey, CAST(allocation_weight AS DOUBLE) AS allocation_weight, row_number() OVER (PARTITION BY l_partkey ORDER BY allocation_weight DESC, l_suppkey) = 1 AS is_primary FROM a")
def weighted_bridge(t):
    return dimensional.bridge(part_suppliers(t), "l_partkey", "l_suppkey", "allocation_weight").withColumn("allocation_weight", F.col("allocation_weight").cast("double"))


@query(f"WITH {BRIDGE} SELECT l_suppkey, CAST(sum(CAST(p_retailprice AS DECIMAL(12, 2)) * allocation_weight) AS DOUBLE) AS weighted_price, CAST(sum(CAST(p_retailprice AS DECIMAL(12, 2))) AS DOUBLE) AS exposure_price FROM part JOIN a ON p_partkey = l_partkey GROUP BY l_suppkey")
def bridge_allocation(t):
    fact = t("part").select(F.col("p_partkey").alias("l_partkey"), money("p_retailprice").alias("price"))
    b = part_suppliers(t)
    both = dimensional.allocate(fact, b, "l_partkey", "l_suppkey", "price").join(dimensional.allocate(fact, b, "l_partkey", "l_suppkey", "price", weighted=False), "l_suppkey")
    return both.select("l_suppkey", *(F.col(c).cast("double").alias(c) for c in ("weighted_price", "exposure_price")))


@query(f"""WITH {USER_VERSIONS} SELECT f.event_id, CAST(strftime(f.ts, '%Y%m%d') AS INTEGER) AS added_date_key, coalesce(arg_max(v.sk, v.effective_from), {UNKNOWN}) AS user_sk
FROM events f LEFT JOIN v ON f.user_id = v.user_id AND f.ts >= v.effective_from - INTERVAL 1 SECOND AND f.ts < v.effective_to WHERE f.event_type = 'click' GROUP BY f.event_id, f.ts""")
def factless_clicks(t):
    f = t("events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    out = history.wide_pit_join(f, user_versions(t), "user_id", "ts", "event_id", {"sk": "user_sk"}, unknown={"user_sk": unknown_key()})
    return out.select("event_id", date_key("ts").alias("added_date_key"), "user_sk")


@query(f"""SELECT o_orderkey, coalesce(CASE WHEN c_custkey IS NOT NULL THEN md5(c_custkey::VARCHAR) END, {UNKNOWN}) AS customer_sk, md5(o_orderpriority || '-' || o_orderstatus) AS junk_sk,
CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS billing_date_key, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS amount
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) ON o_custkey = c_custkey""")
def transaction_fact(t):
    dim = t("customer").where("c_custkey % 7 <> 0").select("c_custkey", surrogate_key("c_custkey").alias("sk"))
    j = dimensional.junk(t("orders"), ["o_orderpriority", "o_orderstatus"], "sk", {"o_orderpriority": "Unknown", "o_orderstatus": "Unknown"})
    f = history.lookup(t("orders"), dim, {"o_custkey": "c_custkey"}, {"sk": "customer_sk"}, {"customer_sk": unknown_key()})
    f = history.lookup(f, j, {"o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus"}, {"sk": "junk_sk"})
    return f.select("o_orderkey", "customer_sk", "junk_sk", date_key("o_orderdate").alias("billing_date_key"), money("o_totalprice").cast("double").alias("amount"))


def scratch(spark: SparkSession) -> Catalog:
    return Catalog(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def incremental_merge(t):
    """Three batches by watermark, one of them replayed by a backfill, end as the full table."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp_ntz")
    c = scratch(o.sparkSession)
    stale = o.withColumn("o_orderstatus", F.lit("?")).where("o_orderkey % 3 = 1").withColumn("_ingested_at", day(1))
    c.incremental("orders", o.where("o_orderkey % 3 = 0").withColumn("_ingested_at", day(1)).unionByName(stale), ["o_orderkey"])
    log = o.where("o_orderkey % 3 > 0").withColumn("_ingested_at", F.when(F.col("o_orderkey") % 3 == 1, day(2)).otherwise(day(3)))
    c.incremental("orders", log, ["o_orderkey"])
    c.incremental("orders", log, ["o_orderkey"])  # nothing is new
    c.incremental("orders", log, ["o_orderkey"], backfill=Backfill(datetime(2024, 1, 2), datetime(2024, 1, 3)))
    return c.table("orders").drop("_ingested_at")


GOOD, ALL = "(SELECT count(*) FROM nation WHERE n_nationkey < 5)", "(SELECT count(*) FROM nation WHERE n_nationkey < 8)"


@query(f"SELECT 'before' AS moment, {GOOD} AS n UNION ALL SELECT 'bad', {ALL} UNION ALL SELECT 'travel', {GOOD} UNION ALL SELECT 'after', {GOOD}")
def time_travel(t):
    """Good rows, then bad ones, a look back, and a reset of the branch."""
    df = t("nation").select("n_nationkey", "n_name")
    c = scratch(df.sparkSession)
    c.append("demo", df.where("n_nationkey < 5"))
    good = c.get_reference()
    out = [("before", c.table("demo").count())]
    c.append("demo", df.where("n_nationkey between 5 and 7"))
    bad = c.get_reference()
    out += [("bad", c.table("demo").count()), ("travel", c.at(f"main@{good.hash}").table("demo").count())]
    c.assign_reference("main", bad.hash, good.hash)
    return small_frame(df.sparkSession, [*out, ("after", c.table("demo").count())], "moment string, n long")


@query("SELECT n_nationkey::BIGINT AS id, n_name AS title, CASE WHEN n_nationkey >= 10 THEN n_regionkey END AS region FROM nation")
def schema_evolution(t):
    """A rename, a widening, a drop and an added column over old files, and a new partition spec."""
    df = t("nation").select("n_nationkey", "n_name", F.lit(1).alias("junk"))
    c = scratch(df.sparkSession)
    c.append("n", df.where("n_nationkey < 10"))
    c.rename_column("n", "n_name", "title")
    c.rename_column("n", "n_nationkey", "id")
    c.alter_type("n", "id", "bigint")
    c.drop_column("n", "junk")
    c.add_column("n", "region", "int", after="id")
    c.set_partition("n", ["bucket(id,4)"])
    c.append("n", t("nation").where("n_nationkey >= 10").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("title")))
    return c.table("n")


@query(f"""WITH {USER_VERSIONS}, {BRIDGE}
SELECT 'not_null' AS test, count(*) AS failures FROM orders WHERE o_orderkey % 11 = 0 UNION ALL SELECT 'unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'relationships', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) UNION ALL SELECT 'accepted_values', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'accepted_range', count(*) FROM lineitem WHERE l_quantity < 2 OR l_quantity > 40 UNION ALL SELECT 'expression', count(*) FROM orders WHERE NOT (o_totalprice > 1000)
UNION ALL SELECT 'ranges', count(*) FROM (SELECT user_id FROM v GROUP BY user_id HAVING count(*) > 1) UNION ALL SELECT 'last_range', count(*) FROM (SELECT user_id FROM v GROUP BY user_id HAVING count(*) = 1)
UNION ALL SELECT 'pair', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'weights', count(*) FROM (SELECT l_partkey FROM a WHERE l_suppkey % 5 <> 0 GROUP BY l_partkey HAVING sum(allocation_weight) <> 1)
UNION ALL SELECT 'same_count', CASE WHEN (SELECT count(*) FROM orders) <> (SELECT count(*) FROM lineitem) THEN 1 ELSE 0 END
UNION ALL SELECT 'distinct_count', CASE WHEN (SELECT count(DISTINCT o_custkey) FROM orders) <> (SELECT count(DISTINCT c_custkey) FROM customer) THEN 1 ELSE 0 END
UNION ALL SELECT 'reconciles', count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 2 = 0""")
def data_tests(t):
    """Each test on rows that break it: keys blanked, intervals cut short, weights left out."""
    o, li = t("orders"), t("lineitem")
    flagged = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("F").alias("status"))
    v = user_versions(t)
    short = v.withColumn("effective_to", F.when((F.col("scd_version") == 1) & (F.col("effective_to") < F.lit("9000-01-01").cast("timestamp_ntz")), F.col("effective_to") - F.expr("interval 1 microsecond")).otherwise(F.col("effective_to")))
    ended = v.withColumn("effective_to", F.when((F.col("scd_version") == 1) & (F.col("effective_to") > F.lit("9000-01-01").cast("timestamp_ntz")), F.lit("9000-01-01").cast("timestamp_ntz")).otherwise(F.col("effective_to")))
    return checks.report(
        not_null=checks.not_null(o.withColumn("k", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey"))), "k"), unique=checks.unique(li, "l_orderkey", "l_linenumber"), relationships=checks.relationships(o, "o_custkey", t("customer").where("c_custkey % 10 <> 0"), "c_custkey"),
        accepted_values=checks.accepted_values(o, "o_orderstatus", ["F", "O"]), accepted_range=checks.accepted_range(li, "l_quantity", 2, 40), expression=checks.expression_is_true(o, "o_totalprice > 1000"),
        ranges=checks.exclusive_ranges(short, "effective_from", "effective_to", "user_id"), last_range=checks.exclusive_ranges(ended, "effective_from", "effective_to", "user_id", last="9999-12-31 23:59:59.999999"),
        pair=checks.at_least(shipped(t), "l_shipdate", "o_orderdate"),
        weights=checks.grouped_expression_is_true(part_suppliers(t).where("l_suppkey % 5 <> 0"), ["l_partkey"], F.sum("allocation_weight"), "value = 1"), same_count=checks.same_count(o, li),
        distinct_count=checks.same_distinct_count(o, "o_custkey", t("customer"), "c_custkey"), reconciles=checks.reconciles(o, flagged, {"o_orderkey": "o_orderkey"}, ("o_orderstatus", "status")),
    )


@query("""SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS net_revenue, count(*) FILTER (o_orderstatus = 'O') AS n_open,
count(DISTINCT o_custkey) AS n_customers, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS n_large, round(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS pending_ratio
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
def analyst_rollup(t):
    df = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return df.groupBy("c_mktsegment", F.year("o_orderdate").alias("y")).agg(
        F.sum(sign * money("o_totalprice")).cast("double").alias("net_revenue"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_distinct("o_custkey").alias("n_customers"),
        F.sum(F.when(F.col("o_totalprice") > 100000, 1).otherwise(0)).alias("n_large"), F.round(F.sum(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)) / F.count("*"), 6).alias("pending_ratio"),
    )


@query("""SELECT o_orderkey, CAST(isodow(o_orderdate) AS INTEGER) AS dow, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS k, strftime(o_orderdate, '%Y-%m-%d') AS back, strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59.999999' AS eod,
CAST(date_diff('second', TIMESTAMP '1995-01-01', o_orderdate) AS BIGINT) AS secs, CAST(CAST(least(o_totalprice / 250000.0::DOUBLE, 1.0) AS DECIMAL(5, 4)) AS DOUBLE) AS capped, md5(coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END, '_dbt_utils_surrogate_key_null_') || '-' || o_orderkey::VARCHAR) AS sk FROM orders""")
def scalar_functions(t):
    d = "o_orderdate"
    return t("orders").select("o_orderkey", iso_weekday(d).cast("int").alias("dow"), date_key(d).alias("k"), from_date_key(date_key(d)).cast("string").alias("back"), timestamp_text(end_of_day(d)).alias("eod"), seconds_between(F.lit("1995-01-01").cast("timestamp_ntz"), d).alias("secs"), capped_ratio("o_totalprice", F.lit(250000.0)).cast("double").alias("capped"), surrogate_key(F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")), "o_orderkey").alias("sk"))


@query("SELECT md5(coalesce(text, '_null_')) AS payload, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def payload_duplicates(t):
    from tidemark.functions import payload_hash

    df = t("documents").select("text")
    return df.select(payload_hash(df).alias("payload")).groupBy("payload").agg(F.count("*").alias("copies")).where("copies > 1")


@query("""SELECT o_custkey, o_orderstatus AS plan, CASE WHEN o_orderstatus <> was THEN was END AS previous_plan, CASE WHEN o_orderstatus <> was THEN '2002-01-01' END AS plan_change_date FROM
(SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) FILTER (o_orderdate < TIMESTAMP '1999-01-01') AS was FROM orders GROUP BY o_custkey)""")
def scd1_and_scd3(t):
    o = t("orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderstatus").alias("plan"))
    now = lambda df: history.scd1(df, "o_custkey", desc("o_orderdate", "o_orderkey")).select("o_custkey", "plan")
    before = history.scd3(now(o.where("o_orderdate < timestamp_ntz'1999-01-01'")), None, "o_custkey", ["plan"], F.lit(date(2000, 1, 1)))
    return history.scd3(now(o), before, "o_custkey", ["plan"], F.lit(date(2002, 1, 1))).withColumn("plan_change_date", F.col("plan_change_date").cast("string"))


@query("SELECT event_type, count(*) AS n FROM (SELECT event_type, ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id % 97, event_id) AS late FROM events) WHERE late GROUP BY event_type")
def out_of_order(t):
    from pyspark.sql import Window

    late = F.col("ts") < F.lag("ts").over(Window.partitionBy("user_id").orderBy(F.col("event_id") % 97, "event_id"))
    return t("events").withColumn("late", late).where("late").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def semi_and_anti(t):
    keys = t("orders").select(F.col("o_custkey").alias("c_custkey"))
    c = t("customer").select("c_custkey")
    return c.join(keys, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(keys, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


# the table layer, ingest and publishing


def counts(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return small_frame(spark, rows, "moment string, n long")


@query(f"""SELECT 'main before' AS moment, {GOOD} AS n UNION ALL SELECT 'branch', {ALL} UNION ALL SELECT 'main after', {ALL} UNION ALL SELECT 'merged twice', 0 UNION ALL SELECT 'refused', 1""")
def branch_and_merge(t):
    """Rows on a branch are not on main until it is merged; a stale expected hash is refused; the branch goes by its hash."""
    df = t("nation").select("n_nationkey", "n_name")
    c = scratch(df.sparkSession)
    c.append("demo", df.where("n_nationkey < 5"))
    head = c.get_reference()
    c.create_branch("dev")
    c.at("dev").append("demo", df.where("n_nationkey between 5 and 7"))
    out = [("main before", c.table("demo").count()), ("branch", c.at("dev").table("demo").count())]
    c.merge_branch("dev", "main", head.hash)
    out += [("main after", c.table("demo").count()), ("merged twice", int(c.merge_branch("dev").was_applied))]
    try:
        c.delete_reference("dev", head.hash)
    except CatalogError:
        out.append(("refused", 1))
    c.delete_reference("dev", c.at("dev").get_reference().hash)
    return counts(df.sparkSession, out)


@query("""SELECT 'snapshots' AS moment, 4::BIGINT AS n UNION ALL SELECT 'manifests', 4 UNION ALL SELECT 'history', 4 UNION ALL SELECT 'rows by file', count(*) FROM nation UNION ALL SELECT 'rows by partition', count(*) FROM nation
UNION ALL SELECT 'largest key', max(n_nationkey) FROM nation UNION ALL SELECT 'log of appends', 2""")
def metadata_tables(t):
    """Snapshots, manifests, history, files and partitions of a table that was created, appended to twice and merged into."""
    df = t("nation").select("n_nationkey", "n_name")
    c = scratch(df.sparkSession)
    c.append("n", df.where("n_nationkey < 5"))
    c.append("n", df.where("n_nationkey between 5 and 9"))
    c.merge("n", df.where("n_nationkey >= 4"), ["n_nationkey"])
    files = c.files("n")
    top = files.agg(F.max(F.col("upper_bounds")["n_nationkey"].cast("int"))).first()[0]
    return counts(df.sparkSession, [("snapshots", c.snapshots("n").count()), ("manifests", c.manifests("n").count()), ("history", c.history("n").count()), ("rows by file", files.agg(F.sum("record_count")).first()[0]),
        ("rows by partition", c.partitions("n").agg(F.sum("record_count")).first()[0]), ("largest key", top), ("log of appends", len(c.get_log(contains="append to n")))])


@query(f"""SELECT 'created' AS moment, 0::BIGINT AS n UNION ALL SELECT 'inserted', {GOOD} UNION ALL SELECT 'as select', {ALL} UNION ALL SELECT 'refreshed', {GOOD} UNION ALL SELECT 'other columns refused', 1
UNION ALL SELECT 'narrower type refused', 1 UNION ALL SELECT 'compacted files', 1 UNION ALL SELECT 'tables after drop', 1 UNION ALL SELECT 'commits that remain', 1""")
def table_lifecycle(t):
    """CREATE, INSERT, CREATE AS SELECT, full refresh, refused changes, compaction, DROP and expiry."""
    df = t("nation").select("n_nationkey", "n_name")
    c = scratch(df.sparkSession)
    c.create_table("a", df.schema, ["bucket(n_nationkey,2)"])
    out = [("created", c.table("a").count())]
    c.append("a", df.where("n_nationkey < 5"))
    out.append(("inserted", c.table("a").count()))
    c.overwrite("b", df.where("n_nationkey < 8"))
    out.append(("as select", c.table("b").count()))
    c.overwrite("b", df.where("n_nationkey < 3"))
    c.append("b", df.where("n_nationkey between 3 and 4"))
    out.append(("refreshed", c.table("b").count()))
    for step, change in (("other columns refused", lambda: c.append("b", df.withColumn("more", F.lit(1)))), ("narrower type refused", lambda: c.alter_type("b", "n_nationkey", "smallint"))):
        try:
            change()
        except CatalogError:
            out.append((step, 1))
    c.compact("b")
    out.append(("compacted files", c.files("b").count()))
    c.drop_table("a")
    out.append(("tables after drop", len(c.tables())))
    c.expire_snapshots(now=datetime(2999, 1, 1))
    return counts(df.sparkSession, [*out, ("commits that remain", len(c.get_log()))])


def files_of(t: Callable, folder: str, part: str, columns: list[str], mode: str = "append") -> None:
    t("nation").where(part).select(*columns).coalesce(1).write.mode(mode).parquet(folder)


@query("""SELECT n_nationkey, n_name, CASE WHEN n_nationkey >= 10 THEN n_regionkey END AS n_regionkey, true AS described, 2::BIGINT AS n_files, 1::BIGINT AS n_batches_of_file FROM nation""")
def ingest_files(t):
    """Two files of different columns, each taken once though ingest runs three times, with source file, clock, batch and hash on every row."""
    spark = t("nation").sparkSession
    c, root = scratch(spark), f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    schemas = {"nation": t("nation").select("n_nationkey", "n_name", "n_regionkey").schema}
    files_of(t, f"{root}/nation", "n_nationkey < 10", ["n_nationkey", "n_name"])
    bronze.ingest(c, root, schemas)
    files_of(t, f"{root}/nation", "n_nationkey >= 10", ["n_nationkey", "n_name", "n_regionkey"])
    bronze.ingest(c, root, schemas)
    bronze.ingest(c, root, schemas)
    rows = c.table("bronze.nation")
    each = rows.groupBy("_source_file").agg(F.count_distinct("_batch_id").alias("n_batches_of_file"))
    whole = rows.agg(F.count_distinct("_source_file").alias("n_files"))
    described = F.col("_ingested_at").isNotNull() & F.col("_batch_id").isNotNull() & (F.length("_payload_hash") > 0)
    return rows.join(each, "_source_file").crossJoin(whole).select("n_nationkey", "n_name", "n_regionkey", described.alias("described"), "n_files", "n_batches_of_file")


@query("SELECT n_nationkey, n_name, 1::BIGINT AS times FROM nation")
def stream_files(t):
    """A stream drains a folder, is stopped, and goes on with what came since: every row arrives once."""
    spark = t("nation").sparkSession
    c, root = scratch(spark), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = t("nation").select("n_nationkey", "n_name").schema
    for part in ("n_nationkey < 10", "n_nationkey >= 10"):
        files_of(t, f"{root}/in", part, ["n_nationkey", "n_name"])
        drain(c, f"{root}/in", schema, "n", f"{root}/state")
    return c.table("n").groupBy("n_nationkey", "n_name").agg(F.count("*").alias("times"))


@query("""SELECT 'clean exit' AS moment, 0::BIGINT AS n UNION ALL SELECT 'clean rows', count(*) FROM nation UNION ALL SELECT 'bad exit', 5 UNION ALL SELECT 'bad tables', 0 UNION ALL SELECT 'none exit', 2 UNION ALL SELECT 'built before it', 2""")
def publish_audited(t):
    """Write, audit, publish: what passes its tests reaches main, what fails stays on its branch; name+ selects all that follows."""
    df = t("nation").select("n_nationkey", "n_name")
    spark = df.sparkSession
    c, p = scratch(spark), Project()
    c.append("bronze.nation", df)
    unique = {"unique": lambda x: checks.unique(x, "n_nationkey")}
    p.model(("bronze.nation",), name="clean", tests=unique)(lambda x: x)
    p.model(("clean",), name="bad", tests=unique)(lambda x: x.unionByName(x.where("n_nationkey < 3")))
    good, bad, none = (write_audit_publish(p, c, x) for x in ("clean", "bad", "nothing_of_this_name"))
    return counts(spark, [("clean exit", good.exit_code), ("clean rows", c.table("clean").count()), ("bad exit", bad.exit_code), ("bad tables", int(c.exists("bad"))), ("none exit", none.exit_code), ("built before it", len(p.select("clean+")))])


@query(SQL["periodic_snapshot"])
def rolling_snapshot(t):
    """The periodic snapshot, built in parts: first days, a rolling window of three days, and a backfill of dates that stale rows had taken."""
    roster = t("events").groupBy("user_id").agg(F.min("ts").cast("date").alias("a"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).cast("date").alias("b"))
    versions, c = user_versions(t), scratch(t("events").sparkSession)

    def build(lower: date, upper: date) -> DataFrame:
        out = dimensional.periodic_snapshot(roster, versions, "user_id", "a", "b", lower, upper, {"tier": "tier"})
        return out.select("user_id", "snapshot_date", "snapshot_date_key", "tenure_days", "tier")

    stale = lambda lower, upper: build(lower, upper).withColumn("tier", F.lit("stale"))
    how = {"column": "snapshot_date", "first": date(2024, 1, 3)}
    dimensional.refresh_snapshot(c, "s", stale, upto=date(2024, 1, 12), **how)
    dimensional.refresh_snapshot(c, "s", build, upto=date(2024, 1, 12), start=date(2024, 1, 3), stop=date(2024, 1, 10), **how)
    dimensional.refresh_snapshot(c, "s", build, upto=date(2024, 1, 12), **how)
    dimensional.refresh_snapshot(c, "s", build, upto=date(2024, 1, 28), **how)
    return c.table("s").select("user_id", "snapshot_date_key", "tenure_days", "tier")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def commit_watermark(t):
    """The time of the last commit is the watermark: rows that were ingested before it are not merged again, later ones are."""
    o = t("orders").select("o_orderkey", "o_orderstatus")
    c = scratch(o.sparkSession)
    at = lambda df, day: df.withColumn("_ingested_at", F.lit(day).cast("timestamp_ntz"))
    c.incremental("o", at(o, "2024-01-01"), ["o_orderkey"], by_commit=True)
    stale, new = (o.where("o_orderkey % 3 = 1").withColumn("o_orderstatus", F.lit(x)) for x in ("stale", "new"))
    c.incremental("o", at(stale, "2024-01-02"), ["o_orderkey"], by_commit=True)
    c.incremental("o", at(stale, "2024-01-02").unionByName(at(new, "2999-01-01")), ["o_orderkey"], by_commit=True)
    return c.table("o").drop("_ingested_at")


# measures, ranks and buckets


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS effective_from, coalesce(strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), '%Y-%m-%d'), '9999-12-31') AS effective_to,
CASE WHEN o_orderstatus = 'O' THEN 0 WHEN o_orderkey % 2 = 0 THEN ((CAST(round(o_totalprice * 100) AS BIGINT) + 6) // 12) / 100.0::DOUBLE ELSE CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) END AS mrr FROM o WHERE rn = 1""")
def ledger_revenue(t):
    """Ledger rows as intervals, with the month's revenue: nothing in trial, a twelfth of an annual price, else the price."""
    o = t("orders").withColumns({"status": F.when(F.col("o_orderstatus") == "O", "trial").otherwise("active"), "period": F.when(F.col("o_orderkey") % 2 == 0, "annual").otherwise("monthly"), "price": money("o_totalprice")})
    v = dimensional.ledger_intervals(o, "o_custkey", "o_orderdate", desc("o_orderkey"))
    day = lambda c: F.substring(F.col(c).cast("string"), 1, 10).alias(c)
    return v.select("o_orderkey", day("effective_from"), day("effective_to"), dimensional.monthly_revenue("status", "price", "period").cast("double").alias("mrr"))


@query("SELECT CAST(o_orderdate AS DATE)::VARCHAR AS day, o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS price, true AS refused FROM orders GROUP BY ALL")
def semi_additive(t):
    """A measure that may be summed over status but not over days."""
    fact = dimensional.SemiAdditive(t("orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderstatus", money("o_totalprice").alias("price")), "day", ["price"])
    refused = False
    try:
        fact.total("price", ["o_orderstatus"])
    except ValueError:
        refused = True
    return fact.total("price", ["day", "o_orderstatus"]).select(F.col("day").cast("string").alias("day"), "o_orderstatus", F.col("price").cast("double").alias("price"), F.lit(refused).alias("refused"))


@query("SELECT count(*) AS rows, true AS same_in_other_order, true AS tells_a_change FROM orders")
def checksums(t):
    """A table's checksum does not depend on the order of rows or on audit columns, and tells a changed value."""
    o = t("orders")
    a = checksum(o)
    b = checksum(o.repartition(7, "o_custkey").withColumn("loaded_at", F.current_timestamp()))
    c = checksum(o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 1, "?").otherwise(F.col("o_orderstatus"))))
    same = lambda x, y: (F.col(f"{x}.xor") == F.col(f"{y}.xor")) & (F.col(f"{x}.total") == F.col(f"{y}.total"))
    return a.alias("a").crossJoin(b.alias("b")).crossJoin(c.alias("c")).select(F.col("a.rows").alias("rows"), same("a", "b").alias("same_in_other_order"), (~same("a", "c")).alias("tells_a_change"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, true AS near FROM events GROUP BY event_type")
def approximate_users(t):
    """HyperLogLog++ within five times its relative error of the exact number."""
    out = t("events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.approx_count_distinct("user_id", 0.01).alias("about"))
    return out.select("event_type", "n_users", (F.abs(F.col("about") - F.col("n_users")) <= F.greatest(F.col("n_users") * 0.05, F.lit(2.0))).alias("near"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_number FROM lineitem")
def global_rank(t):
    """Every line's place by price, over ranges rather than in one window."""
    order = [F.desc("l_extendedprice"), *asc("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ranking.global_row_number(df, order).select("l_orderkey", "l_linenumber", "row_number")


@query("SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS row_number FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_orders(t):
    return ranking.top(t("orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10)


@query("SELECT CAST(l_orderkey % 4 AS INTEGER) AS bucket, count(*) AS failures FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY ALL")
def duplicates_by_bucket(t):
    """Uniqueness, one bucket of keys at a time."""
    parts = [checks.unique(checks.in_bucket(t("lineitem"), "l_orderkey", 4, k), "l_orderkey", "l_linenumber").select(F.lit(k).alias("bucket")) for k in range(4)]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole.groupBy("bucket").agg(F.count("*").alias("failures"))


@query("""WITH m AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)
SELECT strftime(a.day, '%Y-%m-%d') AS day, count(*) AS n_active, count(b.user_id) AS n_back, round(count(b.user_id) / count(*), 6) AS back_ratio FROM m a LEFT JOIN m b ON b.user_id = a.user_id AND b.day = a.day + 1 GROUP BY a.day""")
def analyst_retention(t):
    """Active users by day, and how many of them are back the day after."""
    m = t("events").select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    back = m.select("user_id", F.date_sub("day", 1).alias("day"), F.lit(1).alias("back"))
    out = m.join(back, ["user_id", "day"], "left").groupBy("day").agg(F.count("*").alias("n_active"), F.count("back").alias("n_back"))
    return out.select(F.col("day").cast("string").alias("day"), "n_active", "n_back", F.round(F.col("n_back") / F.col("n_active"), 6).alias("back_ratio"))


@query("""SELECT r_name, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS revenue, round(CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) / (SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) FROM orders), 4) AS share
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def analyst_regions(t):
    """Revenue by region with its share of all."""
    o = t("orders").select("o_custkey", money("o_totalprice").alias("price"))
    whole = o.agg(F.sum("price").cast("double").alias("whole"))
    by = o.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return by.groupBy("r_name").agg(F.sum("price").cast("double").alias("revenue")).crossJoin(F.broadcast(whole)).select("r_name", "revenue", F.round(F.col("revenue") / F.col("whole"), 4).alias("share"))


@query("""SELECT c_mktsegment, o_custkey, spent, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY spent DESC, o_custkey) AS place FROM
(SELECT c_mktsegment, o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12, 2))) AS DOUBLE) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)) WHERE place <= 5""")
def analyst_best_customers(t):
    """The five customers of each segment who spent most."""
    from pyspark.sql import Window

    by = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "o_custkey").agg(F.sum(money("o_totalprice")).cast("double").alias("spent"))
    return by.withColumn("place", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("spent"), "o_custkey"))).where("place <= 5")


@query("""SELECT o_orderkey, CAST(substr(strftime(o_orderdate, '%Y%m%d'), 1, 6) AS BIGINT) AS month, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice / 100000 END >= 0.9, false) AS finished, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS flag,
lower(substr(o_orderpriority, 3, 4)) || '_' || lpad(o_orderkey::VARCHAR, 8, '0') AS tag, true AS has_clock FROM orders""")
def scalar_functions_of_text(t):
    ratio = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice") / 100000)
    month = F.substring(date_key("o_orderdate").cast("string"), 1, 6).cast("long")
    tag = F.concat_ws("_", F.lower(F.substring("o_orderpriority", 3, 4)), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    return t("orders").select("o_orderkey", month.alias("month"), F.coalesce(ratio >= 0.9, F.lit(False)).alias("finished"), (F.col("o_orderstatus") == "F").cast("string").alias("flag"), tag.alias("tag"), F.current_timestamp().isNotNull().alias("has_clock"))
