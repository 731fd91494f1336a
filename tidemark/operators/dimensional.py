"""Calendar, junk and role-playing dimensions, bridges, and the fact builders on top of dimensions."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import date_key, end_of_day, high, int_div, iso_weekday, seconds_between, surrogate_key


def date_spine(spark: SparkSession, start: date, stop: date) -> DataFrame:
    """date_day from start up to, but without, stop."""
    days = (stop - start).days
    return spark.range(max(days, 0)).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date_day"))


def _nth(month: int, weekday: int, n: int) -> Column:
    return (F.col("month_number") == month) & (F.col("day_of_week") == weekday) & (int_div(F.col("day_of_month") - 1, 7) + 1 == n)


def _fixed(month: int, day: int) -> Column:
    return (F.col("month_number") == month) & (F.col("day_of_month") == day)


#: US federal holidays on their actual dates; days of the week count from Monday, 1.
HOLIDAYS: list[tuple[str, Column]] = []


def _holidays() -> list[tuple[str, Column]]:
    last_monday_of_may = (F.col("month_number") == 5) & (F.col("day_of_week") == 1) & (F.month(F.date_add("date_day", 7)) == 6)
    return [
        ("New Year's Day", _fixed(1, 1)),
        ("Martin Luther King Jr. Day", _nth(1, 1, 3)),
        ("Presidents' Day", _nth(2, 1, 3)),
        ("Memorial Day", last_monday_of_may),
        ("Juneteenth", _fixed(6, 19)),
        ("Independence Day", _fixed(7, 4)),
        ("Labor Day", _nth(9, 1, 1)),
        ("Columbus Day", _nth(10, 1, 2)),
        ("Veterans Day", _fixed(11, 11)),
        ("Thanksgiving Day", _nth(11, 4, 4)),
        ("Christmas Day", _fixed(12, 25)),
    ]


def calendar(spark: SparkSession, start: date, stop: date) -> DataFrame:
    """A row for each day from start up to, but without, stop, with ISO weeks, a fiscal year from 1 July named by its end, and holidays."""
    d = F.col("date_day")
    df = date_spine(spark, start, stop).select(
        date_key(d).alias("date_key"), d, iso_weekday(d).alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), F.dayofmonth(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"), F.month(d).alias("month_number"), F.date_format(d, "MMMM").alias("month_name"), F.quarter(d).alias("quarter_number"), F.year(d).alias("year_number"),
        (iso_weekday(d) >= 6).alias("is_weekend"), (F.dayofmonth(d) == 1).alias("is_month_start"), (d == F.last_day(d)).alias("is_month_end"),
    )
    m = F.col("month_number")
    df = df.withColumn("fiscal_month", ((m + 5) % 12 + 1).cast("int"))
    df = df.withColumns({"fiscal_quarter": int_div(F.col("fiscal_month") - 1, 3) + 1, "fiscal_year": F.when(m >= 7, F.col("year_number") + 1).otherwise(F.col("year_number"))})
    name = F.lit(None).cast("string")
    for title, when in reversed(_holidays()):
        name = F.when(when, F.lit(title)).otherwise(name)
    return df.withColumn("holiday_name", name).withColumn("is_holiday", F.col("holiday_name").isNotNull())


def role_view(dates: DataFrame, role: str) -> DataFrame:
    """The calendar under another name: its keys renamed, never stored."""
    return dates.withColumnsRenamed({"date_key": f"{role}_date_key", "date_day": f"{role}_date"})


def junk(df: DataFrame, cols: list[str], sk: str, unknown: dict[str, object]) -> DataFrame:
    """Every combination of the values that cols hold, and one sentinel row. Domains are distinct values of flags and codes,
    so the product is of a handful of rows."""
    out = None
    for c in cols:
        domain = df.select(c).where(F.col(c).isNotNull()).distinct()
        out = domain if out is None else out.crossJoin(domain)
    types = {f.name: f.dataType for f in df.schema.fields}
    sentinel = df.sparkSession.range(1).select(*(F.lit(unknown[c]).cast(types[c]).alias(c) for c in cols))
    return out.unionByName(sentinel).distinct().select(surrogate_key(*cols).alias(sk), *cols)


def bridge(df: DataFrame, owner: str, member: str, weight: str) -> DataFrame:
    """An M:N bridge with is_primary: the owner's heaviest member, the first by name among equals."""
    w = Window.partitionBy(owner).orderBy(F.col(weight).desc_nulls_last(), F.col(member).asc_nulls_last())
    return df.select(owner, member, weight, (F.row_number().over(w) == 1).alias("is_primary"))


def weights(df: DataFrame, owner: str, member: str, amount: str, digits: int = 4) -> DataFrame:
    """Shares of amount within each owner as decimals that sum to exactly 1: what rounding leaves goes to the last member."""
    kind = f"decimal(6,{digits})"
    whole = Window.partitionBy(owner)
    order = Window.partitionBy(owner).orderBy(F.col(member).asc_nulls_last())
    df = df.withColumn("_share", F.round(F.col(amount).cast("double") / F.sum(amount).over(whole).cast("double"), digits).cast(kind))
    df = df.withColumns({"_rest": (F.lit(1).cast(kind) - F.sum("_share").over(whole) + F.col("_share")).cast(kind), "_last": F.lead(member).over(order).isNull() & (F.row_number().over(order) == F.count("*").over(whole))})
    return df.withColumn("allocation_weight", F.when(F.col("_last"), F.col("_rest")).otherwise(F.col("_share"))).drop("_share", "_rest", "_last")


def allocate(fact: DataFrame, bridged: DataFrame, owner: str, member: str, measure: str, weighted: bool = True) -> DataFrame:
    """A measure summed by member: shared out by weight, or as exposure, in full to each member, which counts it more than once."""
    value = F.sum(F.col(measure) * F.col("allocation_weight")) if weighted else F.sum(measure)
    return fact.join(bridged, owner).groupBy(member).agg(value.alias(f"{'weighted' if weighted else 'exposure'}_{measure}"))


def ledger_intervals(ledger: DataFrame, key: str, at: str, ties: list[Column]) -> DataFrame:
    """Ledger rows as half-open intervals up to the key's next row, one row for each instant."""
    from tidemark.operators.history import keep_first

    one = keep_first(ledger, [key, at], ties).withColumnRenamed(at, "effective_from")
    return one.withColumn("effective_to", F.coalesce(F.lead("effective_from").over(Window.partitionBy(key).orderBy("effective_from")), high()))


def periodic_snapshot(roster: DataFrame, versions: DataFrame, key: str, start: str, end: str, lower: date, upper: date, take: dict[str, str]) -> DataFrame:
    """A row for each member and day on which it is there, within [lower, upper], with the version valid at that day's last instant.

    roster has a start date and an end date, which may be null, for each member. Days are exploded only inside the bounds, and
    only where they do not run backwards, since a sequence would count down.
    """
    from tidemark.operators.history import pit_join

    a, b = F.greatest(F.col(start), F.lit(lower)), F.least(F.coalesce(F.col(end), F.lit(upper)), F.lit(upper))
    days = roster.where(F.col(start).isNotNull()).withColumns({"_a": a, "_b": b}).where("_b >= _a")
    days = days.withColumn("snapshot_date", F.explode(F.sequence("_a", "_b", F.expr("interval 1 day")))).drop("_a", "_b")
    days = days.withColumns({"snapshot_date_key": date_key("snapshot_date"), "_at": end_of_day("snapshot_date"), "tenure_days": F.datediff("snapshot_date", start) + 1})
    return pit_join(days, versions, key, "_at", take).drop("_at")


def refresh_snapshot(catalog, table: str, build, column: str, first: date, upto: date, days: int = 3, start: date | None = None, stop: date | None = None) -> tuple[date, date]:
    """Bring a snapshot table up to a day, and return the days that were built; build(lower, upper) gives their rows.

    A table that is not there is built from its first day. Otherwise the last ``days`` days, and all that followed the table's last
    day, are built again and take the place of what was there; with start or stop, a range of dates is filled back instead. Other days' files are not read.
    """
    lower, upper = first, upto
    if catalog.exists(table):
        if start or stop:
            lower, upper = start or first, stop or upto
        else:
            last = catalog.table(table).agg(F.max(column)).first()[0]
            lower = max(first, min(upto - timedelta(days=days - 1), last + timedelta(days=1) if last else first))
    catalog.replace_range(table, build(lower, upper), column, lower, upper)
    return lower, upper


def audited(df: DataFrame, now: datetime) -> DataFrame:
    """df with loaded_at, the build's clock; ``checksum`` leaves it out."""
    return df.withColumn("loaded_at", F.lit(now).cast("timestamp_ntz"))


def monthly_revenue(status: str, price: str, period: str) -> Column:
    """0 in trial and pause and for an unknown plan; a twelfth of an annual price; else the price."""
    p = F.col(price)
    mrr = F.when(F.col(status).isin("trial", "paused") | p.isNull(), F.lit(0)).when(F.col(period) == "annual", F.round(p / 12, 2)).otherwise(p)
    return mrr.cast("decimal(10,2)")


def milestones(events: DataFrame, key: str, at: str, kind: str, steps: list[str]) -> DataFrame:
    """The first time of each kind of event for each key: one aggregation, a column a step."""
    return events.where(F.col(kind).isin(steps)).groupBy(key).agg(*(F.min(F.when(F.col(kind) == s, F.col(at))).alias(f"{s}_at") for s in steps))


def accumulating_snapshot(df: DataFrame, steps: list[str], lags: dict[str, tuple[str, str]], now: datetime, expire_days: int = 30) -> DataFrame:
    """Milestone date keys, lags in hours and funnel_status.

    A lag is null unless both of its milestones are reached. completed: the last step is reached; expired: the step before
    the first lag's end began more than expire_days before now; in_progress otherwise. A row without a first step never expires.
    """
    out = df.withColumns({f"{s}_date_key": date_key(f"{s}_at") for s in steps})
    for name, (a, b) in lags.items():
        out = out.withColumn(name, F.round(seconds_between(f"{a}_at", f"{b}_at").cast("decimal(18,6)") / 3600, 2).cast("decimal(10,2)"))
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {expire_days} days")
    status = F.when(F.col(f"{steps[-1]}_at").isNotNull(), "completed").when(F.col(f"{steps[0]}_at") < limit, "expired").otherwise("in_progress")
    return out.withColumn("funnel_status", status)


class SemiAdditive:
    """A fact whose measures may be summed over any dimension but one."""

    def __init__(self, fact: DataFrame, over: str, measures: list[str]):
        self.fact, self.over, self.measures = fact, over, measures

    def total(self, measure: str, by: list[str]) -> DataFrame:
        """Sums by the columns given, which must hold the dimension over which sums have no meaning."""
        if measure in self.measures and self.over not in by:
            raise ValueError(f"{measure} cannot be summed over {self.over}")
        return self.fact.groupBy(*by).agg(F.sum(measure).alias(measure))
