"""Generated sources through ingest and all models, against the manifests of what is wrong with them."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import checksum, unknown_key
from tidemark.operators import checks
from tidemark.plans import streaming_video
from tidemark.sources import bronze
from tidemark.sources.generator import Generator, Scale
from tidemark.sources.tables import Catalog

NOW = datetime(2024, 6, 1)
SMALL = Scale(subscribers=60, titles=20, devices=10, sessions=1500, ledger=200, watchlist=100, signups=60, batches=4, malformed=0.03, duplicates=0.05)


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("video"))
    g = Generator(spark, 5, SMALL)
    g.write(f"{root}/src")
    c = Catalog(spark, f"{root}/lake")
    files = bronze.ingest(c, f"{root}/src", streaming_video.SCHEMAS, now=NOW)
    p = streaming_video.project(NOW, date(2024, 3, 1))
    assert p.lint() == []
    results = p.build(c)
    assert {r.name: (r.status, r.failures, r.error[:500]) for r in results if r.status != "ok"} == {}
    return c, p, g, files


def test_sources(lake):
    c, _, g, files = lake
    assert files["playback_sessions"] == SMALL.batches + 1 and g.playback_sessions().count() == SMALL.sessions
    t = c.table("bronze.playback_sessions")
    assert t.count() == SMALL.sessions + g.midstream_targets().count() and 0 < t.where("playback_quality is null").count() < SMALL.sessions
    assert checks.grouped_expression_is_true(c.table("silver_title_genres"), ["title_id"], F.sum("allocation_weight"), "value = 1").count() == 0


def test_gate_finds_the_malformed(lake):
    c, _, g, _ = lake
    want = {tuple(r) for r in g.manifests()["malformed_playback_events"].collect()}
    got = {tuple(r) for r in c.table("silver_playback_sessions_rejected").select("playback_session_id", "rejection_reason").collect()}
    assert got == want and len({k for _, k in want}) == 3
    assert c.table("silver_playback_sessions").count() + len(got) == c.table("bronze.playback_sessions").count()


def test_duplicates_and_late_members(lake):
    c, _, g, _ = lake
    assert c.table("silver_billing_ledger").count() == SMALL.ledger and g.manifests()["duplicate_billing_ids"].count() > 0
    late = {r[0] for r in g.manifests()["late_arriving_subscribers"].collect()}
    d = c.table("dim_subscriber")
    assert late and {r[0] for r in d.where("is_inferred and is_current").select("subscriber_id").collect()} == late
    assert d.where(F.col("is_current")).groupBy("subscriber_id").count().where("count <> 1").count() == 0


def test_facts_resolve(lake):
    c, _, _, _ = lake
    for fact, dims in (("fct_playback_events", ("subscriber", "title", "device")), ("fct_billing_transactions", ("subscriber", "plan", "payment_method")), ("fct_watchlist_adds", ("subscriber", "title")), ("fct_daily_subscription_snapshot", ("subscriber", "plan")), ("fct_signup_funnel", ("subscriber", "plan"))):
        df = c.table(fact)
        assert df.count() > 0
        for d in dims:
            assert checks.relationships(df, f"{d}_sk", c.table(f"dim_{d}"), f"{d}_sk").count() == 0, (fact, d)
    playback = c.table("fct_playback_events")
    assert playback.where(F.col("subscriber_sk") == unknown_key()).count() == 0 and 0 < playback.where(F.col("device_sk") == unknown_key()).count() < 0.1 * SMALL.sessions


def test_sanity(lake):
    c, _, g, _ = lake
    got = g.sanity(f"{c.root}/../src").collect()
    assert all(r.ok for r in got), got
    assert {r.defect for r in got if r.expected > 0} >= {"late members without an event", "sessions at mid-stream targets", "malformed sessions", "billing ids twice"}


def test_midstream_targets_find_the_older_version(lake):
    """A fact between two changes belongs to the version of its time, though a newer one exists."""
    c, _, g, _ = lake
    want = {r.constructed_id: r for r in g.midstream_targets().collect()}
    f = c.table("fct_playback_events").where(F.col("playback_session_id").isin(list(want)))
    d = c.table("dim_subscriber").select("subscriber_sk", "subscriber_id", "effective_from", "effective_to")
    got = f.join(d, "subscriber_sk").collect()
    assert len(got) == len(want) > 5
    for r in got:
        t = want[r.playback_session_id]
        assert r.subscriber_id == t.subscriber_id and r.effective_from <= t.older_version_effective_from and r.effective_to >= t.older_version_effective_to
    assert g.spark.createDataFrame(got).where("effective_to < timestamp_ntz'9999-01-01'").count() > 0


def test_erased_and_soft_deleted(lake):
    c, _, g, _ = lake
    erased, soft = ({r[0] for r in g.manifests()[m].collect()} for m in ("hard_deleted_subscribers", "soft_deleted_subscribers"))
    d = c.table("dim_subscriber").where("is_current")
    status = {r.subscriber_id: r.status for r in d.collect()}
    # a soft delete is an event that ends in the churned status; an erased member has no event at all after it
    assert erased and soft and any(status[x] == "churned" for x in soft)
    gone = {r.subscriber_id: r.hard_deleted_at for r in g.manifests()["hard_deleted_subscribers"].collect()}
    last = {r.subscriber_id: str(r.at) for r in c.table("bronze.subscriber_events").groupBy("subscriber_id").agg(F.max("change_timestamp").alias("at")).collect()}
    assert all(last[x] < gone[x] for x in erased)


def test_builds_are_idempotent(lake):
    c, p, _, _ = lake
    names = ["fct_billing_transactions", "dim_subscriber", "fct_watchlist_adds"]
    before = [checksum(c.table(n)).first() for n in names]
    assert all(r.status == "ok" for r in p.build(c, " ".join(f"{n}" for n in names)))
    assert [checksum(c.table(n)).first() for n in names] == before
    assert all(r.status == "ok" for r in p.run(c, "fct_watchlist_adds", full_refresh=True)) and checksum(c.table("fct_watchlist_adds")).first() == before[2]


def test_late_members_heal(lake):
    """When the sign-ups come after all, their members are no longer inferred, and facts of before still resolve."""
    c, p, g, _ = lake
    late = {r[0] for r in g.manifests()["late_arriving_subscribers"].collect()}
    before = {r.playback_session_id: r.subscriber_sk for r in c.table("fct_playback_events").collect()}
    g.write_late(f"{c.root}/../src")
    assert bronze.ingest(c, f"{c.root}/../src", streaming_video.SCHEMAS, now=NOW)["subscriber_events"] == 1
    assert all(r.status == "ok" for r in p.build(c, "silver_subscriber_events dim_subscriber"))
    d = c.table("dim_subscriber")
    assert {r[0] for r in d.where("is_current and not is_inferred").select("subscriber_id").collect()} >= late
    sks = {r[0] for r in d.select("subscriber_sk").collect()}
    assert set(before.values()) <= sks | {None}
