"""Seeded, deliberately dirty source data for a subscription-video business, with manifests of its defects.

Every value is a hash of the seed, a label and the row's number, so it depends neither on partitioning nor on other rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the source system.
TIERS = ["basic", "standard", "premium", "premium_plus"]
STATUSES = ["trial", "active", "paused", "cancelled", "deleted"]
PAYMENTS = ["card", "paypal", "gift_card", "carrier_billing"]
DEVICES = ["tv", "mobile", "tablet", "web", "console"]
GENRES = ["action", "comedy", "drama", "documentary", "horror", "romance"]
START = "2023-01-01"


@dataclass(frozen=True)
class Scale:
    """Row counts and shares of defects."""

    subscribers: int = 200
    titles: int = 60
    devices: int = 40
    sessions: int = 5_000
    ledger: int = 600
    watchlist: int = 400
    signups: int = 200
    batches: int = 10
    duplicates: float = 0.01
    stragglers: float = 0.03
    null_device: float = 0.02
    malformed: float = 0.003
    drift: float = 0.4
    late: float = 0.02
    midstream: int = 20


#: About 1/50 of the full scale, and the full one: 120 million sessions.
PRESETS = {"small": Scale(2_500, 400, 100, 2_400_000, 30_000, 15_000, 1_300, 40), "full": Scale(125_000, 20_000, 5_000, 120_000_000, 1_500_000, 750_000, 63_000, 200)}
#: A subscriber of each so many is erased so many days after signing up: no event of theirs is later.
ERASED, ERASED_AFTER = 13, 30


class Generator:
    """DataFrames of each source; write() lays them out as files, a folder an entity."""

    def __init__(self, spark: SparkSession, seed: int = 1, scale: Scale | None = None):
        self.spark, self.seed, self.scale = spark, seed, scale or Scale()

    def u(self, label: str, *cols: str) -> Column:
        """A uniform number in [0, 1) for a label and a row."""
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(label), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def pick(self, label: str, values: list, *cols: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (self.u(label, *cols) * len(values)).cast("int") + 1)

    def skewed(self, label: str, n: int, *cols: str) -> Column:
        """Whole numbers below n, the small ones more often."""
        return (F.pow(self.u(label, *cols), 2.0) * n).cast("long")

    @staticmethod
    def ident(prefix: str, c: Column, digits: int) -> Column:
        return F.concat(F.lit(prefix), F.lpad(c.cast("string"), digits, "0"))

    def when(self, label: str, days: int, *cols: str) -> Column:
        """A time within so many days of the start, in whole seconds."""
        return F.timestamp_add("SECOND", (self.u(label, *cols) * days * 86400).cast("long"), F.lit(START).cast("timestamp_ntz"))

    def plans(self) -> DataFrame:
        df = self.spark.range(8)
        tier, annual = F.element_at(F.array(*map(F.lit, TIERS)), (F.col("id") % 4 + 1).cast("int")), F.col("id") >= 4
        price = (F.col("id") % 4 * 4 + 6).cast("double") - 0.01
        period, level = F.when(annual, "annual").otherwise("monthly"), (F.col("id") % 4).cast("int")
        return df.select(
            self.ident("plan_", F.col("id"), 2).alias("plan_id"), F.concat(F.initcap(F.translate(tier, "_", " ")), F.lit(" "), period).alias("plan_name"), tier.alias("current_tier"), F.when(annual, price * 10).otherwise(price).alias("current_price_usd"), period.alias("billing_period"),
            (level + 1).cast("long").alias("max_concurrent_streams"), F.element_at(F.array(*map(F.lit, ("sd", "hd", "hd", "uhd"))), level + 1).alias("video_quality"), ((level == 0) & ~annual).alias("has_ads"), (level > 0).alias("supports_downloads"),
        )

    def devices(self) -> DataFrame:
        kind = self.pick("device", DEVICES, "id")
        maker = self.pick("maker", ["Aster", "Boreal", "Cobalt", "Dune"], "id")
        return self.spark.range(self.scale.devices).select(
            self.ident("dev_", F.col("id"), 5).alias("device_id"), kind.alias("device_type"), maker.alias("manufacturer"), F.concat(maker, F.lit("-"), (self.u("model", "id") * 9000 + 100).cast("int").cast("string")).alias("model_name"),
            F.concat(kind, F.lit("_os")).alias("os_name"), kind.isin("mobile", "tablet").alias("is_mobile"),
        )

    def title_genres(self) -> DataFrame:
        """One to three genres a title; what rounding leaves of the weights goes to the last, so that they sum to 1.0000."""
        n = (self.u("genres", "id") * 3).cast("int") + 1
        df = self.spark.range(self.scale.titles).select("id", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
        share = F.round(F.lit(1.0) / F.col("n"), 4).cast("decimal(6,4)")
        weight = F.when(F.col("k") < F.col("n") - 1, share).otherwise(F.lit(1).cast("decimal(6,4)") - share * (F.col("n") - 1))
        genre = F.element_at(F.array(*map(F.lit, GENRES)), ((F.col("id") + F.col("k")) % len(GENRES) + 1).cast("int"))
        return df.select(self.ident("tt_", F.col("id"), 5).alias("title_id"), genre.alias("genre_name"), weight.cast("double").alias("allocation_weight"))

    def title_events(self) -> DataFrame:
        df = self.spark.range(self.scale.titles * 3).withColumn("title", F.col("id") % self.scale.titles).withColumn("k", F.floor(F.col("id") / self.scale.titles))
        return df.select(
            self.ident("tt_", F.col("title"), 5).alias("title_id"), self.ident("ttev_", F.col("id"), 8).alias("change_event_id"),
            F.when(F.col("k") == 0, F.lit("2022-06-01").cast("timestamp_ntz")).otherwise(self.when("title_at", 500, "id")).alias("change_timestamp"),
            self.ident("Title ", F.col("title"), 3).alias("title_name"), self.pick("rating", ["G", "PG", "R"], "title", "k").alias("maturity_rating"),
            F.when(F.col("title") % 4 > 0, "movie").otherwise("series").alias("content_type"), (self.u("year", "title") * 29 + 1995).cast("long").alias("release_year"), self.pick("language", ["en", "es", "de", "hi"], "title").alias("original_language"),
            F.when(F.col("title") % 4 > 0, (self.u("runtime", "title") * 100 + 40).cast("long")).alias("runtime_minutes"),
        )

    def subscriber_events(self) -> DataFrame:
        """Sign-ups and later changes; every tenth subscriber changes twice on one day, some end as deleted, and some are erased: nothing of them comes later."""
        n = self.scale.subscribers
        df = self.spark.range(n * 4).withColumn("s", F.col("id") % n).withColumn("k", F.floor(F.col("id") / n))
        out = self._events_of(df)
        erased = self._erased_at("_s")
        return out.withColumn("_s", F.substring("subscriber_id", 5, 9).cast("long")).where(erased.isNull() | (F.col("change_timestamp") < erased)).drop("_s")

    def late_subscriber_events(self) -> DataFrame:
        """Sign-ups of members whose facts came first."""
        n = self.scale.subscribers
        return self._events_of(self.spark.range(5).select((F.col("id") + n * 4).alias("id"), (F.col("id") + n).alias("s"), F.lit(0).cast("long").alias("k")))

    def _erased_at(self, s: str) -> Column:
        """When a subscriber is erased, null for most."""
        return F.when(F.col(s) % ERASED == 5, F.timestamp_add("DAY", F.lit(ERASED_AFTER), self.when("signup", 300, s)))

    def _events_of(self, df: DataFrame) -> DataFrame:
        at = F.timestamp_add("MICROSECOND", F.col("k") * 3_600_000_000 * F.when(F.col("s") % 10 == 0, 1).otherwise(1 + self.skewed("gap", 2000, "id")) + F.col("id"), self.when("signup", 300, "s"))
        status = F.when(F.col("k") == 0, "trial").when((F.col("k") == 3) & (F.col("s") % 7 == 0), F.lit("deleted")).otherwise(self.pick("status", STATUSES[1:4], "id"))
        return df.select(
            self.ident("sub_", F.col("s"), 6).alias("subscriber_id"), self.ident("subev_", F.col("id"), 8).alias("change_event_id"), at.alias("change_timestamp"),
            F.when(F.col("k") == 0, "signup").otherwise("profile_update").alias("change_type"), F.concat(F.lit("s"), F.col("s").cast("string"), F.lit("."), F.col("k").cast("string"), F.lit("@mail.example")).alias("email"),
            F.concat(F.lit("Member "), F.col("s").cast("string")).alias("display_name"), self.pick("channel", ["organic", "ads", "partner", "referral"], "s").alias("acquisition_channel"),
            self.pick("country", ["US", "DE", "BR", "IN"], "s").alias("country_code"), F.to_date(at).alias("signup_date"), self.pick("tier", TIERS, "s", "k").alias("plan_tier"), status.alias("status"),
        )

    def _subscriber(self, label: str) -> Column:
        """A subscriber of a fact; a share of them has no event at all and arrives late, if ever."""
        known = self.skewed(label, self.scale.subscribers, "id")
        return self.ident("sub_", F.when(self.u(f"late_{label}", "id") < self.scale.late, F.lit(self.scale.subscribers) + known % 5).otherwise(known), 6)

    def playback_sessions(self) -> DataFrame:
        s, kind = self.scale, self.u("malformed", "id")
        # sessions lie between a subscriber's sign-up and erasure
        known = self.skewed("viewer", s.subscribers, "id")
        df = self.spark.range(s.sessions).withColumn("s", F.when(self.u("late_viewer", "id") < s.late, F.lit(s.subscribers) + known % 5).otherwise(known))
        first = F.timestamp_add("SECOND", F.lit(1), self.when("signup", 300, "s"))
        until = F.coalesce(self._erased_at("s"), F.timestamp_add("DAY", F.lit(400), F.lit(START).cast("timestamp_ntz")))
        span = F.timestamp_diff("SECOND", first, until)
        start, watched = F.timestamp_add("SECOND", (self.u("session", "id") * (span - 1)).cast("long"), first), (self.u("watched", "id") * 7200).cast("long")
        began = F.when(kind.between(2 / 3 * s.malformed, s.malformed), F.lit("2099-01-01").cast("timestamp_ntz")).otherwise(start)
        batch = (F.datediff(start, F.lit(START)) * s.batches / 400).cast("int")
        late = self.u("straggler", "id") < s.stragglers
        return df.select(
            self.ident("pb_", F.col("id"), 12).alias("playback_session_id"), self.ident("sub_", F.col("s"), 6).alias("subscriber_id"), self.ident("tt_", self.skewed("title", s.titles, "id"), 5).alias("title_id"),
            F.when(self.u("device_null", "id") >= s.null_device, self.ident("dev_", self.skewed("device_of", s.devices, "id"), 5)).alias("device_id"), began.alias("session_started_at"),
            F.when(kind.between(s.malformed / 3, 2 / 3 * s.malformed - 1e-12), F.timestamp_add("SECOND", F.lit(-60), began)).otherwise(F.timestamp_add("SECOND", watched, began)).alias("session_ended_at"),
            F.when(kind < s.malformed / 3, -watched - 1).otherwise(watched).alias("watch_duration_seconds"), (self.u("buffer", "id") * 4).cast("int").alias("buffering_count"),
            F.round(self.u("percent", "id"), 4).alias("playback_percent"), self.pick("bitrate", [600, 1500, 3500, 8000], "id").cast("long").alias("avg_bitrate_kbps"),
            self.pick("quality", ["sd", "hd", "uhd"], "id").alias("playback_quality"), F.when(late, F.least(batch + 3, F.lit(s.batches - 1))).otherwise(batch).alias("batch"),
        )

    def midstream_targets(self) -> DataFrame:
        """Times in the middle of a subscriber's second interval, with a third after it: a join as of these must find the second version, not the newest."""
        w = Window.partitionBy("subscriber_id").orderBy("change_timestamp")
        e = self.subscriber_events().select("subscriber_id", F.col("change_timestamp").alias("older_version_effective_from"), F.lead("change_timestamp").over(w).alias("older_version_effective_to"), F.row_number().over(w).alias("k"))
        gap = F.timestamp_diff("SECOND", "older_version_effective_from", "older_version_effective_to")
        e = e.where((F.col("k") == 2) & (gap > 10) & (F.col("older_version_effective_to") < F.timestamp_add("DAY", F.lit(480), F.lit(START).cast("timestamp_ntz"))))
        e = e.orderBy("subscriber_id").limit(self.scale.midstream).withColumn("n", F.row_number().over(Window.orderBy("subscriber_id")))  # as many rows as the preset asks
        at = F.timestamp_add("SECOND", (gap / 2).cast("long"), F.date_trunc("second", "older_version_effective_from").cast("timestamp_ntz"))
        return e.select(self.ident("pb_", F.col("n") + self.scale.sessions, 12).alias("constructed_id"), "subscriber_id", at.alias("event_timestamp"), "older_version_effective_from", "older_version_effective_to")

    def midstream_sessions(self) -> DataFrame:
        """A session at each of these times."""
        s = self.scale
        return self.midstream_targets().withColumn("id", F.substring("constructed_id", 4, 12).cast("long")).select(
            F.col("constructed_id").alias("playback_session_id"), "subscriber_id", self.ident("tt_", self.skewed("title", s.titles, "id"), 5).alias("title_id"), self.ident("dev_", self.skewed("device_of", s.devices, "id"), 5).alias("device_id"),
            F.col("event_timestamp").alias("session_started_at"), F.timestamp_add("SECOND", F.lit(600), "event_timestamp").alias("session_ended_at"), F.lit(600).cast("long").alias("watch_duration_seconds"), F.lit(0).alias("buffering_count"),
            F.lit(0.5).alias("playback_percent"), F.lit(3500).cast("long").alias("avg_bitrate_kbps"), F.lit("hd").alias("playback_quality"),
        )

    def _twice(self, df: DataFrame, label: str, key: str) -> DataFrame:
        return df.unionByName(df.where(self.u(label, key) < self.scale.duplicates))

    def billing_ledger(self) -> DataFrame:
        amount = F.round(self.u("amount", "id") * 30 + 5, 2)
        kind = self.pick("billing", ["charge", "charge", "charge", "refund"], "id")
        signed = F.when(kind == "refund", -amount).otherwise(amount)
        df = self.spark.range(self.scale.ledger).select(
            self.ident("bill_", F.col("id"), 9).alias("billing_transaction_id"), self._subscriber("payer").alias("subscriber_id"), self.ident("plan_", self.skewed("plan", 8, "id"), 2).alias("plan_id"),
            self.pick("payment", PAYMENTS, "id").alias("payment_type"), (self.u("promo", "id") < 0.2).alias("is_promo_applied"), (self.u("retry", "id") < 0.1).alias("is_retry"), (self.u("autopay", "id") < 0.7).alias("is_autopay"),
            kind.alias("transaction_type"), self.when("posted", 400, "id").alias("transaction_posted_at"), signed.alias("amount_usd"), F.round(signed * 0.0725, 2).alias("tax_amount_usd"),
        )
        return self._twice(df, "billing_twice", "billing_transaction_id")

    def watchlist_adds(self) -> DataFrame:
        return self.spark.range(self.scale.watchlist).select(self.ident("wl_", F.col("id"), 9).alias("watchlist_event_id"), self._subscriber("lister").alias("subscriber_id"), self.ident("tt_", self.skewed("listed", self.scale.titles, "id"), 5).alias("title_id"), self.when("listed_at", 400, "id").alias("added_at"))

    def signup_funnel(self) -> DataFrame:
        at, out = self.when("attempt", 300, "id"), [self.ident("sig_", F.col("id"), 8).alias("signup_id")]
        steps = [("registered_at", 0.9), ("email_verified_at", 0.8), ("payment_method_added_at", 0.75), ("plan_selected_at", 0.85), ("first_stream_at", 0.7)]
        reached, cols = F.lit(True), {"attempt_started_at": at}
        for k, (name, share) in enumerate(steps):
            reached = reached & (self.u(name, "id") < share)
            cols[name] = F.when(reached, F.timestamp_add("SECOND", F.lit((k + 1) * 600), at))
        out += [F.when(cols["registered_at"].isNotNull(), self.ident("sub_", F.col("id") % self.scale.subscribers, 6)).alias("subscriber_id"), *(c.alias(n) for n, c in cols.items())]
        out.append(F.when(cols["plan_selected_at"].isNotNull(), self.ident("plan_", self.skewed("chosen", 8, "id"), 2)).alias("plan_id_selected"))
        return self._twice(self.spark.range(self.scale.signups).select(*out), "signup_twice", "signup_id")

    ENTITIES = ("plans", "devices", "title_genres", "title_events", "subscriber_events", "playback_sessions", "billing_ledger", "watchlist_adds", "signup_funnel")

    def _file(self, df: DataFrame, root: str, entity: str, name: str) -> None:
        """df as one Parquet file of an entity's folder."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = f"{root}/{entity}/_write-{name}"
        df.coalesce(1).write.option("compression", "zstd").parquet(folder)
        system = fs.Path(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for x in system.listStatus(fs.Path(folder)):
            if x.getPath().getName().endswith(".parquet"):
                system.rename(x.getPath(), fs.Path(f"{root}/{entity}/part-{name}.parquet"))
        system.delete(fs.Path(folder), True)

    def write(self, root: str) -> None:
        """A Parquet file for each entity, and for playback one for each batch and one of mid-stream targets; before the drift cutoff playback has no quality column."""
        for name in self.ENTITIES:
            df = getattr(self, name)()
            parts = [df] if name != "playback_sessions" else [df.where(F.col("batch") == b).drop("batch", *["playback_quality"] * (b < self.scale.drift * self.scale.batches)) for b in range(self.scale.batches)]
            for k, part in enumerate(parts):
                self._file(part, root, name, f"{k:05d}")
        self._file(self.midstream_sessions(), root, "playback_sessions", "midstream")
        for name, df in self.manifests().items():
            df.coalesce(1).write.option("header", True).csv(f"{root}/manifests/{name}")

    def write_late(self, root: str) -> None:
        """The file that comes last: sign-ups of members whose facts are there already."""
        self._file(self.late_subscriber_events(), root, "subscriber_events", "late")

    def manifest(self, root: str, name: str) -> DataFrame:
        """A manifest as it was written."""
        return self.spark.read.option("header", True).csv(f"{root}/manifests/{name}")

    def sanity(self, root: str) -> DataFrame:
        """(defect, expected, found, ok): whether the files hold every defect that the manifests tell of, and no other."""
        read = lambda e: self.spark.read.option("mergeSchema", True).parquet(f"{root}/{e}")
        p, b, s = read("playback_sessions"), read("billing_ledger"), read("subscriber_events")
        facts = p.select("subscriber_id").unionByName(b.select("subscriber_id"))
        again = lambda df, k, m: df.groupBy(k).count().where("count > 1").join(self.manifest(root, m), k, "left_semi")
        mid = self.manifest(root, "midstream_join_targets").select(F.col("constructed_id").alias("playback_session_id"), F.col("event_timestamp").cast("timestamp_ntz").alias("session_started_at"))
        erased = self.manifest(root, "hard_deleted_subscribers").select("subscriber_id", F.col("hard_deleted_at").cast("timestamp_ntz").alias("gone"))
        bad = p.where("watch_duration_seconds < 0 or session_ended_at < session_started_at or session_started_at >= timestamp_ntz'2099-01-01'")
        sums = read("title_genres").groupBy("title_id").agg(F.sum(F.col("allocation_weight").cast("decimal(6,4)")).alias("w"))
        m = lambda name: self.manifest(root, name)
        none = self.spark.range(0)
        pairs = {
            "late members without an event": (m("late_arriving_subscribers"), m("late_arriving_subscribers").join(s, "subscriber_id", "left_anti")), "sessions at mid-stream targets": (mid, mid.join(p, ["playback_session_id", "session_started_at"], "left_semi")),
            "malformed sessions": (m("malformed_playback_events"), bad.join(m("malformed_playback_events"), "playback_session_id", "left_semi")), "malformed sessions untold": (none, bad.join(m("malformed_playback_events"), "playback_session_id", "left_anti")),
            "billing ids twice": (m("duplicate_billing_ids"), again(b, "billing_transaction_id", "duplicate_billing_ids")), "sign-up ids twice": (m("duplicate_signup_ids"), again(read("signup_funnel"), "signup_id", "duplicate_signup_ids")),
            "events after erasure": (none, s.join(erased, "subscriber_id").where("change_timestamp >= gone")), "sessions after erasure": (none, p.where("session_started_at < timestamp_ntz'2099-01-01'").join(erased, "subscriber_id").where("session_started_at >= gone")),
            "genre weights that do not sum to 1": (none, sums.where("w <> 1")), "facts of members never heard of": (m("late_arriving_subscribers"), facts.distinct().join(s, "subscriber_id", "left_anti").join(m("late_arriving_subscribers"), "subscriber_id", "left_semi")),
        }
        n = lambda df, c: df.agg(F.count("*").alias(c))
        parts = [n(a, "expected").crossJoin(n(b, "found")).select(F.lit(k).alias("defect"), "expected", "found", (F.col("expected") == F.col("found")).alias("ok")) for k, (a, b) in pairs.items()]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def manifests(self) -> dict[str, DataFrame]:
        """What is wrong with the data, for tests to find again."""
        p, known = self.playback_sessions(), self.subscriber_events().select("subscriber_id").distinct()
        bad = F.when(F.col("watch_duration_seconds") < 0, "negative_duration").when(F.col("session_ended_at") < F.col("session_started_at"), "ended_before_started").when(F.col("session_started_at") >= "2099-01-01", "future_timestamp")
        late = p.select("subscriber_id").unionByName(self.billing_ledger().select("subscriber_id")).unionByName(self.watchlist_adds().select("subscriber_id")).distinct().join(known, "subscriber_id", "left_anti")
        twice = lambda df, key: df.groupBy(key).count().where("count > 1").select(key)
        return {
            "malformed_playback_events": p.select("playback_session_id", bad.alias("malformation_type")).where("malformation_type is not null"), "late_arriving_subscribers": late,
            "duplicate_billing_ids": twice(self.billing_ledger(), "billing_transaction_id"), "duplicate_signup_ids": twice(self.signup_funnel(), "signup_id"),
            "same_day_change_subscribers": self.subscriber_events().groupBy("subscriber_id", F.to_date("change_timestamp").alias("d")).count().where("count > 1").select("subscriber_id").distinct(),
            "midstream_join_targets": self.midstream_targets().withColumns({c: F.col(c).cast("string") for c in ("event_timestamp", "older_version_effective_from", "older_version_effective_to")}),
            "hard_deleted_subscribers": self.spark.range(self.scale.subscribers).select(self.ident("sub_", F.col("id"), 6).alias("subscriber_id"), self._erased_at("id").cast("string").alias("hard_deleted_at")).where("hard_deleted_at is not null"),
            "soft_deleted_subscribers": self.subscriber_events().where("status = 'deleted'").select("subscriber_id").distinct(),
        }
