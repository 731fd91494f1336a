"""The medallion models of the subscription-video business: staging, silver and gold over the nine bronze tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import capped_ratio, date_key, surrogate_key, unknown_key
from tidemark.operators import checks, dimensional, history
from tidemark.operators.history import asc, desc
from tidemark.plans import Project

KINDS = {"string": T.StringType(), "double": T.DoubleType(), "long": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType()}


def schema(text: str) -> T.StructType:
    """A schema from ``name kind, ...``, without a session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


SCHEMAS = {name: schema(ddl) for name, ddl in {
    "plans": "plan_id string, plan_name string, current_tier string, current_price_usd double, billing_period string, max_concurrent_streams long, video_quality string, has_ads boolean, supports_downloads boolean",
    "devices": "device_id string, device_type string, manufacturer string, model_name string, os_name string, is_mobile boolean",
    "title_genres": "title_id string, genre_name string, allocation_weight double",
    "title_events": "title_id string, change_event_id string, change_timestamp timestamp_ntz, title_name string, content_type string, release_year long, original_language string, maturity_rating string, runtime_minutes long",
    "subscriber_events": "subscriber_id string, change_event_id string, change_timestamp timestamp_ntz, change_type string, email string, display_name string, country_code string, acquisition_channel string, signup_date date, plan_tier string, status string",
    "playback_sessions": "playback_session_id string, subscriber_id string, title_id string, device_id string, session_started_at timestamp_ntz, session_ended_at timestamp_ntz, watch_duration_seconds long, playback_percent double, buffering_count long, avg_bitrate_kbps long, playback_quality string",
    "billing_ledger": "billing_transaction_id string, subscriber_id string, plan_id string, payment_type string, is_promo_applied boolean, is_retry boolean, is_autopay boolean, transaction_type string, transaction_posted_at timestamp_ntz, amount_usd double, tax_amount_usd double",
    "watchlist_adds": "watchlist_event_id string, subscriber_id string, title_id string, added_at timestamp_ntz",
    "signup_funnel": "signup_id string, subscriber_id string, attempt_started_at timestamp_ntz, registered_at timestamp_ntz, email_verified_at timestamp_ntz, payment_method_added_at timestamp_ntz, plan_selected_at timestamp_ntz, first_stream_at timestamp_ntz, plan_id_selected string",
}.items()}
CASTS = {"current_price_usd": "decimal(8,2)", "amount_usd": "decimal(10,2)", "tax_amount_usd": "decimal(10,2)", "allocation_weight": "decimal(6,4)"}


def malformed() -> list[history.Rule]:
    return [history.Rule("negative_duration", F.col("watch_duration_seconds") < 0), history.Rule("ended_before_started", F.col("session_ended_at") < F.col("session_started_at")), history.Rule("future_timestamp", F.col("session_started_at") > F.col("_ingested_at"))]


def project(now: datetime, upto: date) -> Project:
    """All models. now is the build's clock and upto the last day of the calendar and of snapshots."""
    p = Project()
    latest = lambda: [*desc("_ingested_at"), *asc("_batch_id")]
    unknown: dict[str, Column] = {"subscriber_sk": unknown_key(), "title_sk": unknown_key(), "device_sk": unknown_key(), "plan_sk": unknown_key()}
    miss = lambda *names: {n: unknown[n] for n in names}

    for name in SCHEMAS:
        p.model((f"bronze.{name}",), name=f"stg_{name}", layer="staging", materialized="view")(lambda df: df.select(*(F.col(c).cast(CASTS[c]).alias(c) if c in CASTS else F.col(c) for c in df.columns)))
    for name, key in {"plans": "plan_id", "devices": "device_id", "watchlist_adds": "watchlist_event_id", "billing_ledger": "billing_transaction_id", "signup_funnel": "signup_id", "subscriber_events": "change_event_id", "title_events": "change_event_id"}.items():
        p.model((f"stg_{name}",), name=f"silver_{name}", tests={"unique": lambda df, key=key: checks.unique(df, key)})(lambda df, key=key: history.keep_first(df, [key], latest()))
    p.model(("stg_title_genres",), name="silver_title_genres")(lambda df: df)
    p.model(("stg_playback_sessions",), name="silver_playback_sessions")(lambda df: history.accepted(df, malformed()))
    p.model(("stg_playback_sessions",), name="silver_playback_sessions_rejected")(lambda df: history.rejected(df, malformed()))

    intervals = lambda key: {"ranges": lambda df: checks.exclusive_ranges(df.where(F.col(key) != "-1"), "effective_from", "effective_to", key)}

    @p.model(("silver_subscriber_events", "silver_playback_sessions", "silver_billing_ledger", "silver_watchlist_adds"), layer="gold", tests=intervals("subscriber_id"))
    def dim_subscriber(events: DataFrame, *facts: DataFrame) -> DataFrame:
        d = history.scd6(events, "subscriber_id", "change_timestamp", "plan_tier", "status", ["email", "display_name", "country_code", "acquisition_channel"], [*desc("_batch_id", "change_event_id")], ["cancelled", "deleted"], ("signup_date", F.col("change_type") == "signup"), "subscriber_sk")
        d = d.withColumn("churn_date_key", date_key("churned_at")).drop("churned_at")
        return history.with_unknown(history.with_inferred(d, [(f, "subscriber_id") for f in facts], "subscriber_sk", "subscriber_id"), "subscriber_sk", "subscriber_id")

    @p.model(("silver_title_events",), layer="gold", tests=intervals("title_id"))
    def dim_title(events: DataFrame) -> DataFrame:
        tracked = ["title_name", "maturity_rating", "runtime_minutes"]
        e = events.select("title_id", "change_timestamp", "change_event_id", "_batch_id", "content_type", "release_year", "original_language", *tracked)
        d = history.scd2(e, "title_id", "change_timestamp", tracked, desc("_batch_id", "change_event_id"), "title_sk").drop("change_event_id", "_batch_id")
        return history.with_unknown(d, "title_sk", "title_id")

    @p.model(("silver_plans",), layer="gold")
    def dim_plan(plans: DataFrame) -> DataFrame:
        d = plans.select(surrogate_key("plan_id").alias("plan_sk"), "plan_id", "plan_name", "current_tier", "current_price_usd", "billing_period", "max_concurrent_streams", "video_quality", "has_ads", "supports_downloads")
        d = history.scd3(d, None, "plan_id", ["current_tier", "current_price_usd"], F.lit(now.date()))
        return history.with_unknown(d, "plan_sk", "plan_id", {"current_price_usd": 0})

    @p.model(("silver_devices",), layer="gold")
    def dim_device(devices: DataFrame) -> DataFrame:
        return history.with_unknown(devices.select(surrogate_key("device_id").alias("device_sk"), "device_id", "device_type", "manufacturer", "model_name", "os_name", "is_mobile"), "device_sk", "device_id")

    flags = ["payment_type", "is_promo_applied", "is_retry", "is_autopay"]
    p.model(("silver_billing_ledger",), name="dim_payment_method", layer="gold")(lambda b: dimensional.junk(b, flags, "payment_method_sk", {"payment_type": "Unknown", "is_promo_applied": False, "is_retry": False, "is_autopay": False}))
    p.model(("silver_plans",), name="dim_date", layer="gold")(lambda df: dimensional.calendar(df.sparkSession, date(2023, 1, 1), upto))
    for role in ("signup", "churn", "billing"):
        p.model(("dim_date",), name=f"dim_{role}_date", layer="gold", materialized="view")(lambda df, role=role: dimensional.role_view(df, role))
    whole = lambda df: checks.grouped_expression_is_true(df, ["title_id"], F.sum("allocation_weight"), "value = 1.0000")
    p.model(("silver_title_genres",), name="bridge_title_genre", layer="gold", tests={"weights": whole})(lambda df: dimensional.bridge(df, "title_id", "genre_name", "allocation_weight"))

    @p.model(("silver_playback_sessions", "dim_subscriber", "dim_title", "dim_device"), layer="gold", materialized="watermark", keys=("playback_session_id",), tests={"unique": lambda df: checks.unique(df, "playback_session_id")})
    def fct_playback_events(s: DataFrame, subs: DataFrame, titles: DataFrame, devices: DataFrame) -> DataFrame:
        f = history.pit_join(s, subs, "subscriber_id", "session_started_at", {"subscriber_sk": "subscriber_sk"}, unknown=miss("subscriber_sk"))
        f = history.pit_join(f, titles, "title_id", "session_started_at", {"title_sk": "title_sk", "runtime_minutes": "runtime_minutes"}, unknown=miss("title_sk"))
        f = history.lookup(f, devices, {"device_id": "device_id"}, {"device_sk": "device_sk"}, miss("device_sk"))
        f = f.withColumn("completion_pct", capped_ratio("watch_duration_seconds", F.col("runtime_minutes") * 60))
        return f.select("playback_session_id", "subscriber_sk", "title_sk", "device_sk", date_key("session_started_at").alias("session_date_key"), "session_started_at", "watch_duration_seconds", F.col("playback_percent").cast("decimal(5,4)").alias("playback_percent"), "avg_bitrate_kbps", F.col("buffering_count").cast("int").alias("buffering_count"), "completion_pct", F.coalesce(F.col("completion_pct") >= 0.9, F.lit(False)).alias("is_completed"), "_ingested_at")

    @p.model(("silver_billing_ledger", "dim_subscriber", "dim_plan", "dim_payment_method"), layer="gold", materialized="watermark", keys=("billing_transaction_id",), tests={"unique": lambda df: checks.unique(df, "billing_transaction_id"), "signs": lambda df: checks.expression_is_true(df, "(transaction_type = 'refund') = (amount_usd < 0)")})
    def fct_billing_transactions(b: DataFrame, subs: DataFrame, plans: DataFrame, methods: DataFrame) -> DataFrame:
        f = history.pit_join(b, subs, "subscriber_id", "transaction_posted_at", {"subscriber_sk": "subscriber_sk"}, unknown=miss("subscriber_sk"))
        f = history.lookup(f, plans, {"plan_id": "plan_id"}, {"plan_sk": "plan_sk"}, miss("plan_sk"))
        f = history.lookup(f, methods, {c: c for c in flags}, {"payment_method_sk": "payment_method_sk"}, {"payment_method_sk": surrogate_key(F.lit("Unknown"), F.lit(False), F.lit(False), F.lit(False))})
        return f.select("billing_transaction_id", "subscriber_sk", "plan_sk", "payment_method_sk", date_key("transaction_posted_at").alias("billing_date_key"), "transaction_type", "amount_usd", "tax_amount_usd", "_ingested_at")

    @p.model(("silver_watchlist_adds", "dim_subscriber", "dim_title"), layer="gold", materialized="watermark", keys=("watchlist_event_id",))
    def fct_watchlist_adds(w: DataFrame, subs: DataFrame, titles: DataFrame) -> DataFrame:
        f = history.wide_pit_join(w, subs, "subscriber_id", "added_at", "watchlist_event_id", {"subscriber_sk": "subscriber_sk"}, unknown=miss("subscriber_sk"))
        f = history.wide_pit_join(f, titles, "title_id", "added_at", "watchlist_event_id", {"title_sk": "title_sk"}, unknown=miss("title_sk"))
        return f.select("watchlist_event_id", "subscriber_sk", "title_sk", date_key("added_at").alias("added_date_key"), "_ingested_at")

    @p.model(("dim_subscriber", "silver_billing_ledger", "dim_plan"), layer="gold", tests={"unique": lambda df: checks.unique(df, "snapshot_date_key", "subscriber_sk")})
    def fct_daily_subscription_snapshot(subs: DataFrame, ledger: DataFrame, plans: DataFrame) -> DataFrame:
        churn = F.to_date(F.col("churn_date_key").cast("string"), "yyyyMMdd")
        roster = subs.where("is_current and signup_date is not null and subscriber_id <> '-1'").select("subscriber_id", "signup_date", churn.alias("churn_date"))
        f = dimensional.periodic_snapshot(roster, subs, "subscriber_id", "signup_date", "churn_date", date(2023, 1, 1), upto, {"subscriber_sk": "subscriber_sk", "status": "status"})
        paid = dimensional.ledger_intervals(ledger, "subscriber_id", "transaction_posted_at", desc("_ingested_at", "billing_transaction_id"))
        f = history.pit_join(f.withColumn("_eod", F.to_timestamp_ntz(F.concat(F.col("snapshot_date").cast("string"), F.lit(" 23:59:59.999999")))), paid, "subscriber_id", "_eod", {"plan_id": "plan_id"})
        f = history.lookup(f, plans, {"plan_id": "plan_id"}, {"plan_sk": "plan_sk", "current_price_usd": "price", "billing_period": "period"}, miss("plan_sk"))
        f = f.withColumn("mrr_usd", dimensional.monthly_revenue("status", "price", "period"))
        return f.where("subscriber_sk is not null").select("snapshot_date_key", "subscriber_sk", "plan_sk", "status", "tenure_days", "mrr_usd")

    @p.model(("silver_signup_funnel", "dim_subscriber", "dim_plan"), layer="gold")
    def fct_signup_funnel(s: DataFrame, subs: DataFrame, plans: DataFrame) -> DataFrame:
        s = s.withColumnsRenamed({"attempt_started_at": "attempt_at", "payment_method_added_at": "payment_at"})
        f = history.wide_pit_join(s, subs, "subscriber_id", "registered_at", "signup_id", {"subscriber_sk": "subscriber_sk"}, unknown=miss("subscriber_sk"))
        f = history.lookup(f, plans, {"plan_id_selected": "plan_id"}, {"plan_sk": "plan_sk"}, miss("plan_sk"))
        steps = ["registered", "email_verified", "payment", "plan_selected", "first_stream"]
        f = dimensional.accumulating_snapshot(f, steps, {"hours_to_verify": ("registered", "email_verified"), "hours_to_payment": ("email_verified", "payment"), "hours_to_stream": ("payment", "first_stream")}, now)
        return f.select("signup_id", "subscriber_sk", "plan_sk", date_key("attempt_at").alias("attempt_date_key"), *(f"{x}_date_key" for x in steps), "hours_to_verify", "hours_to_payment", "hours_to_stream", "funnel_status")

    # tables of the gold layer say when they were built
    for m in p.models.values():
        if m.layer == "gold" and m.materialized != "view":
            m.build = lambda *given, build=m.build: dimensional.audited(build(*given), now)
    return p
