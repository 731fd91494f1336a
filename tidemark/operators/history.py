"""Deduplication, quality gates, slowly changing dimensions and point-in-time joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import HIGH, UNKNOWN_ID, high, low, row_hash, surrogate_key, unknown_key


def desc(*cols: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in cols]


def asc(*cols: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in cols]


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key. Spark limits each partition to first rows before it shuffles, so hot keys stay small."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


@dataclass(frozen=True)
class Rule:
    """A named reason to reject a row."""

    name: str
    when: Column


def _triage(df: DataFrame, rules: list[Rule], strict_null: bool) -> Column:
    reason = F.lit(None).cast("string")
    for r in reversed(rules):
        reason = F.when(r.when, F.lit(r.name)).otherwise(reason)
    if strict_null:
        some = rules[0].when
        for r in rules[1:]:
            some = some | r.when
        reason = F.coalesce(reason, F.when(some.isNull(), F.lit("undetermined")))
    return reason


def outcomes(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with outcome: clean, or the first rule that holds, in one pass; null where the rules are null, as neither accepted nor rejected has such rows."""
    some = rules[0].when
    for r in rules[1:]:
        some = some | r.when
    return df.withColumn("outcome", F.when(~some, F.lit("clean")).otherwise(_triage(df, rules, False)))


def accepted(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that no rule rejects. In three-valued logic a rule that is null passes neither this nor rejected."""
    some = rules[0].when
    for r in rules[1:]:
        some = some | r.when
    return df.where(~some)


def rejected(df: DataFrame, rules: list[Rule], strict_null: bool = False) -> DataFrame:
    """Rows with rejection_reason, the first rule that holds; with strict_null also rows on which the rules are null, as undetermined."""
    return df.withColumn("rejection_reason", _triage(df, rules, strict_null)).where(F.col("rejection_reason").isNotNull())


def conservation(staged: DataFrame, clean: DataFrame, refused: DataFrame) -> DataFrame:
    """A row if staged rows are not the clean and the refused together; the counts are three scans without a shuffle of rows."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(staged, "n_staged").crossJoin(n(clean, "n_clean")).crossJoin(n(refused, "n_rejected")).where("n_staged <> n_clean + n_rejected")


def scd1(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The current state of each key."""
    return keep_first(df, [key], order)


def _changes(events: DataFrame, key: str, at: str, tracked: list[str], ties: list[Column]) -> DataFrame:
    """One event for each key and instant, with the hash of what is tracked."""
    return keep_first(events, [key, at], ties).withColumn("row_hash", row_hash(*tracked))


def scd2(events: DataFrame, key: str, at: str, tracked: list[str], ties: list[Column], sk: str = "sk") -> DataFrame:
    """Versions of each key: half-open intervals [effective_from, effective_to) over which what is tracked stays the same."""
    w = Window.partitionBy(key).orderBy(at)
    e = _changes(events, key, at, tracked, ties).withColumn("_was", F.lag("row_hash").over(w))
    e = e.where("_was is null or _was <> row_hash").drop("_was").withColumnRenamed(at, "effective_from")
    w = Window.partitionBy(key).orderBy("effective_from")
    e = e.withColumns({"effective_to": F.coalesce(F.lead("effective_from").over(w), high()), "scd_version": F.row_number().over(w)})
    return e.withColumns({"is_current": F.col("effective_to") == high(), sk: surrogate_key(key, timestamps=("effective_from",))})


def scd3(df: DataFrame, before: DataFrame | None, key: str, cols: list[str], on: Column) -> DataFrame:
    """Current values with previous_<col> and <col>_change_date, from the table's state before; null at its first build."""
    out = df
    if before is None:
        for f in [f for f in df.schema.fields if f.name in cols]:
            out = out.withColumns({f"previous_{f.name}": F.lit(None).cast(f.dataType), f"{f.name}_change_date": F.lit(None).cast("date")})
        return out
    names = [key, *(x for c in cols for x in (c, f"previous_{c}", f"{c}_change_date"))]
    old = before.select(*(F.col(c).alias(f"_old_{c}") for c in names))
    out = out.join(old, F.col(key) == F.col(f"_old_{key}"), "left")
    for c in cols:
        changed = F.col(f"_old_{key}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
        out = out.withColumns({f"previous_{c}": F.when(changed, F.col(f"_old_{c}")).otherwise(F.col(f"_old_previous_{c}")), f"{c}_change_date": F.when(changed, on).otherwise(F.col(f"_old_{c}_change_date"))})
    return out.drop(*(f"_old_{c}" for c in names))


def scd6(events: DataFrame, key: str, at: str, tier: str, status: str, mirrors: list[str], ties: list[Column], churned: list[str], first: tuple[str, Column] | None = None, sk: str = "sk") -> DataFrame:
    """Type 2 versions over tier and status, with type 3 and type 1 columns on top.

    Statuses in ``churned`` count as 'churned'. previous_<tier> is the tier of the segment before, the same over changes of
    status alone and null in the first segment. Mirrors are the latest event's values, on every version, as is
    current_<tier>. churned_at is where the last segment of status begins, if it is churned, and else null. first
    = (column, condition) mirrors a column of the first event that meets the condition. All windows share one partitioning.
    """
    e = events.withColumn(status, F.when(F.col(status).isin(churned), F.lit("churned")).otherwise(F.col(status)))
    e = _changes(e, key, at, [tier, status], ties)
    w = Window.partitionBy(key).orderBy(at)
    whole = Window.partitionBy(key)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = lambda c: F.when(F.lag(at).over(w).isNull() | ~F.col(c).eqNullSafe(F.lag(c).over(w)), 1).otherwise(0)
    e = e.withColumns({f"_m{i}": moved(c) for i, c in enumerate(("row_hash", tier, status))})
    e = e.withColumns({f"_s{i}": F.sum(f"_m{i}").over(upto) for i in range(3)})
    e = e.withColumns({f"_last_{c}": F.last(c).over(every) for c in [*mirrors, tier, status]})
    e = e.withColumns({"_end_segment": F.max("_s2").over(whole)})
    e = e.withColumn("_churned_at", F.when(F.col(f"_last_{status}") == "churned", F.min(F.when(F.col("_s2") == F.col("_end_segment"), F.col(at))).over(whole)))
    if first:
        e = e.withColumn("_first", F.min(F.when(first[1], F.struct(F.col(at), F.col(first[0])))).over(whole)[first[0]])
    v = e.where("_m0 = 1").withColumnRenamed(at, "effective_from")
    w = Window.partitionBy(key).orderBy("effective_from")
    # where a segment of tiers starts, the version before still has the tier before; later versions carry it on
    v = v.withColumn("_cursor", F.when(F.col("_m1") == 1, F.lag(tier).over(w)))
    v = v.withColumn(f"previous_{tier}", F.max(F.struct("_s1", F.col("_m1"), F.col("_cursor"))).over(Window.partitionBy(key, "_s1"))["_cursor"])
    v = v.withColumns({"effective_to": F.coalesce(F.lead("effective_from").over(w), high()), "scd_version": F.row_number().over(w)})
    out = [key, tier, status, "row_hash", "effective_from", "effective_to", "scd_version", f"previous_{tier}", F.col(f"_last_{tier}").alias(f"current_{tier}"), F.col("_churned_at").alias("churned_at")]
    out += [F.col(f"_last_{m}").alias(m) for m in mirrors]
    out += [F.col("_first").alias(first[0])] if first else []
    v = v.select(*out)
    return v.withColumns({"is_current": F.col("effective_to") == high(), sk: surrogate_key(key, timestamps=("effective_from",))})


def constant_row(schema: T.StructType, like: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row of a schema: the values given, null elsewhere."""
    return like.sparkSession.range(1).select(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def with_unknown(dim: DataFrame, sk: str, key: str, values: dict[str, object] | None = None) -> DataFrame:
    """dim with its unknown member: texts 'Unknown', booleans false, numbers null, valid at all times; values override."""
    given: dict[str, Column] = {sk: unknown_key(), key: F.lit(UNKNOWN_ID), "effective_from": low(), "effective_to": high(), "is_current": F.lit(True), "scd_version": F.lit(1)}
    for f in dim.schema.fields:
        if f.name not in given and isinstance(f.dataType, T.StringType):
            given[f.name] = F.lit("Unknown")
        elif f.name not in given and isinstance(f.dataType, T.BooleanType):
            given[f.name] = F.lit(False)
    given |= {k: F.lit(v) for k, v in (values or {}).items()}
    return dim.unionByName(constant_row(dim.schema, dim, given))


def with_inferred(dim: DataFrame, facts: list[tuple[DataFrame, str]], sk: str, key: str, first_from: bool = True, text: str = "unknown") -> DataFrame:
    """dim, with is_inferred, and an inferred member for each id that facts hold and dim lacks, valid from the low date.

    With first_from, ids of dim get an inferred version up to their first one as well, so that facts merged while
    the member was still inferred keep a row to point to.
    """
    ids = facts[0][0].select(F.col(facts[0][1]).alias(key))
    for df, c in facts[1:]:
        ids = ids.unionByName(df.select(F.col(c).alias(key)))
    ids = ids.where(F.col(key).isNotNull()).distinct()
    began = dim.groupBy(key).agg(F.min("effective_from").alias("_until"))
    ids = ids.join(began, key, "left")
    ids = ids.where("_until > timestamp_ntz'1900-01-01' or _until is null" if first_from else "_until is null")
    values = {key: F.col(key), sk: surrogate_key(F.col(key), timestamps=(low(),)), "effective_from": low(), "effective_to": F.coalesce("_until", high()), "is_current": F.col("_until").isNull(), "is_inferred": F.lit(True), "scd_version": F.lit(0)}
    whole = dim.withColumn("is_inferred", F.lit(False))
    for f in whole.schema.fields:
        if f.name not in values:
            values[f.name] = F.lit(text) if isinstance(f.dataType, T.StringType) else F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(None)
    return whole.unionByName(ids.select(*(values[f.name].cast(f.dataType).alias(f.name) for f in whole.schema.fields)))


def pit_join(fact: DataFrame, dim: DataFrame, key: str, at: str, take: dict[str, str], dim_key: str | None = None, unknown: dict[str, Column] | None = None) -> DataFrame:
    """fact with columns of the version of dim that is valid at the fact's time; take maps dim's columns to new names.

    An equality join on the key with a range condition on top. Intervals are half-open and do not overlap, so a fact
    meets one version at most; misses get the values in unknown, or null.
    """
    d = dim.select(F.col(dim_key or key).alias("_key"), F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), *(F.col(c).alias(n) for c, n in take.items()))
    out = fact.join(d, (F.col(key) == F.col("_key")) & (F.col(at) >= F.col("_from")) & (F.col(at) < F.col("_to")), "left").drop("_key", "_from", "_to")
    return out.withColumns({n: F.coalesce(F.col(n), v) for n, v in (unknown or {}).items()})


def wide_pit_join(fact: DataFrame, dim: DataFrame, key: str, at: str, fact_id: str, take: dict[str, str], tolerance: str = "1 second", dim_key: str | None = None, unknown: dict[str, Column] | None = None) -> DataFrame:
    """pit_join for facts whose clock is coarser than the versions': the interval's start is widened, and of several
    versions the latest is taken. max_by keeps one candidate per fact while it aggregates."""
    d = dim.select(F.col(dim_key or key).alias("_key"), F.col("effective_from").alias("_from"), F.col("effective_to").alias("_to"), F.struct(*(F.col(c).alias(n) for c, n in take.items())).alias("_take"))
    near = fact.select(F.col(fact_id).alias("_fact"), F.col(key).alias("_fk"), F.col(at).alias("_at")).join(d, (F.col("_fk") == F.col("_key")) & (F.col("_at") >= F.expr(f"_from - interval {tolerance}")) & (F.col("_at") < F.col("_to")))
    best = near.groupBy("_fact").agg(F.max_by("_take", "_from").alias("_take"))
    out = fact.join(best, F.col(fact_id) == F.col("_fact"), "left")
    for n in take.values():
        value = F.col(f"_take.{n}")
        out = out.withColumn(n, F.coalesce(value, unknown[n]) if unknown and n in unknown else value)
    return out.drop("_fact", "_take")


def lookup(fact: DataFrame, dim: DataFrame, on: dict[str, str], take: dict[str, str], unknown: dict[str, Column] | None = None) -> DataFrame:
    """An equality left join: on maps fact columns to dim columns; a null never matches. Spark broadcasts dim if its statistics allow."""
    d = dim.select(*(F.col(c).alias(f"_on_{i}") for i, c in enumerate(on.values())), *(F.col(c).alias(n) for c, n in take.items()))
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & (F.col(c) == F.col(f"_on_{i}"))
    out = fact.join(d, cond, "left").drop(*(f"_on_{i}" for i in range(len(on))))
    return out.withColumns({n: F.coalesce(F.col(n), v) for n, v in (unknown or {}).items()})


__all__ = [x for x in dir() if not x.startswith("_") and x != "HIGH"]
_ = HIGH
