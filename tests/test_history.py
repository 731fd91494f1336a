from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import LOW, checksum, payload_hash, strict_greatest, surrogate_key, unknown_key
from tidemark.operators import checks, dimensional, history
from tidemark.operators.history import desc


def day(n, h=0):
    return datetime(2024, 1, n, h)


def test_keys(spark):
    df = spark.createDataFrame([("a", None, day(1), True)], "a string, b string, c timestamp_ntz, d boolean")
    r = df.select(surrogate_key("a", "b").alias("k"), unknown_key().alias("u"), payload_hash(df, ["a", "b"]).alias("p"), surrogate_key("d", timestamps=("c",)).alias("t")).first()
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert r.k == md5("a-_dbt_utils_surrogate_key_null_") and r.u == "6bb61e3b7bce0931da574d19d1d82c88" and r.p == md5("a||_null_") and r.t == md5("true-2024-01-01 00:00:00.000000")
    assert spark.range(1).select(strict_greatest(F.lit(1), F.lit(None).cast("int"))).first()[0] is None


def test_scd6_five_versions(spark):
    """A status change after a plan change keeps the tier of the plan segment before."""
    e = [(1, day(1), 1, "standard", "trial", "a@x"), (1, day(2), 2, "premium", "trial", "a@x"), (1, day(3), 3, "premium", "active", "b@x"), (1, day(4), 4, "premium", "paused", "b@x"), (1, day(4), 5, "premium", "active", "c@x"), (1, day(5), 6, "premium", "paused", "c@x"), (1, day(6), 7, "premium", "cancelled", "d@x"), (1, day(7), 8, "premium", "deleted", "e@x")]
    df = spark.createDataFrame(e, "k int, at timestamp_ntz, id int, tier string, status string, email string")
    got = history.scd6(df, "k", "at", "tier", "status", ["email"], desc("id"), ["cancelled", "deleted"]).orderBy("scd_version").collect()
    assert [(r.tier, r.status, r.previous_tier) for r in got] == [("standard", "trial", None), ("premium", "trial", "standard"), ("premium", "active", "standard"), ("premium", "paused", "standard"), ("premium", "churned", "standard")]
    assert {r.email for r in got} == {"e@x"} and {r.churned_at for r in got} == {day(6)} and [r.is_current for r in got] == [False] * 4 + [True]
    assert all(a.effective_to == b.effective_from for a, b in zip(got, got[1:], strict=False))


def test_inferred_members_stay_resolvable(spark):
    """infer, load facts, then real events arrive: the facts' key is still in the dimension."""
    facts = spark.createDataFrame([(7, day(3))], "k int, at timestamp_ntz")
    none = history.scd2(spark.createDataFrame([], "k int, at timestamp_ntz, v string, id int"), "k", "at", ["v"], desc("id")).drop("id")
    before = history.with_inferred(none, [(facts, "k")], "sk", "k")
    key = history.pit_join(facts, before, "k", "at", {"sk": "sk"}).first().sk
    real = history.scd2(spark.createDataFrame([(7, day(5), "x", 1)], "k int, at timestamp_ntz, v string, id int"), "k", "at", ["v"], desc("id")).drop("id")
    after = history.with_inferred(real, [(facts, "k")], "sk", "k")
    assert after.where(F.col("sk") == key).count() == 1
    assert checks.exclusive_ranges(after, "effective_from", "effective_to", "k").count() == 0 and after.agg(F.min("effective_from")).first()[0] == LOW


def test_gate_three_valued_logic(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    rules = [history.Rule("negative", F.col("x") < 0)]
    clean, bad = history.accepted(df, rules), history.rejected(df, rules)
    assert (clean.count(), bad.count()) == (1, 1) and history.conservation(df, clean, bad).count() == 1
    assert history.conservation(df, clean, history.rejected(df, rules, strict_null=True)).count() == 0


def test_checks_have_teeth(spark):
    """A copy that is corrupted fails the test that the original passes."""
    v = history.scd2(spark.createDataFrame([(1, day(1), "a", 1), (1, day(2), "b", 2), (2, day(1), "a", 3)], "k int, at timestamp_ntz, v string, id int"), "k", "at", ["v"], desc("id"))
    assert checks.exclusive_ranges(v, "effective_from", "effective_to", "k").count() == 0
    late = v.withColumn("effective_to", F.when(F.col("scd_version") == 1, F.col("effective_to") + F.expr("interval 1 hour")).otherwise(F.col("effective_to")))
    assert checks.exclusive_ranges(late.where("k = 1"), "effective_from", "effective_to", "k").count() == 1
    assert checks.unique(v.unionByName(v.limit(1)), "sk").count() == 1 and checks.unique(v, "sk").count() == 0
    assert checks.accepted_range(v, "scd_version", 1, 1).count() == 1 and checks.not_null(v, "v").count() == 0


def test_calendar(spark):
    c = {r.date_day: r for r in dimensional.calendar(spark, date(2024, 1, 1), date(2025, 1, 1)).collect()}
    assert len(c) == 366 and c[date(2024, 12, 30)].week_of_year == 1 and c[date(2024, 7, 1)].fiscal_year == 2025 and c[date(2024, 6, 30)].fiscal_quarter == 4
    assert {d for d, r in c.items() if r.is_holiday} == {date(2024, m, d) for m, d in ((1, 1), (1, 15), (2, 19), (5, 27), (6, 19), (7, 4), (9, 2), (10, 14), (11, 11), (11, 28), (12, 25))}


def test_semi_additive(spark):
    f = dimensional.SemiAdditive(spark.createDataFrame([(1, 2.0), (2, 3.0)], "d int, mrr double"), "d", ["mrr"])
    assert f.total("mrr", ["d"]).count() == 2
    with pytest.raises(ValueError):
        f.total("mrr", [])


def test_checksum_ignores_order_and_clock(spark):
    a = spark.range(10).withColumn("loaded_at", F.lit(1))
    b = spark.range(10).orderBy(F.desc("id")).withColumn("loaded_at", F.lit(2))
    assert checksum(a).first() == checksum(b).first() != checksum(spark.range(11)).first()
