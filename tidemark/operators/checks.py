"""Declarative data tests: each returns the rows that fail, so an empty frame is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _where(df: DataFrame, where: str | None) -> DataFrame:
    return df.where(where) if where else df


def not_null(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    return _where(df, where).where(F.col(column).isNull())


def unique(df: DataFrame, *columns: str, where: str | None = None) -> DataFrame:
    """Values, or combinations of values, that occur more than once; for one column nulls are left out."""
    df = _where(df, where)
    df = df.where(F.col(columns[0]).isNotNull()) if len(columns) == 1 else df
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def relationships(df: DataFrame, column: str, parent: DataFrame, field: str) -> DataFrame:
    """Distinct values without a parent; nulls are not looked up."""
    keys = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    return keys.join(parent.select(F.col(field).alias("value")), "value", "left_anti")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.col(column).isin(values))


def accepted_range(df: DataFrame, column: str, low: object = None, high: object = None) -> DataFrame:
    outside = [F.col(column) < F.lit(low)] * (low is not None) + [F.col(column) > F.lit(high)] * (high is not None)
    return df.where(reduce(Column.__or__, outside, F.lit(False)))


def expression_is_true(df: DataFrame, expression: str, where: str | None = None) -> DataFrame:
    """Rows on which the expression is false or null."""
    return _where(df, where).where(~F.coalesce(F.expr(expression), F.lit(False)))


def grouped_expression_is_true(df: DataFrame, by: list[str], value: Column, expression: str) -> DataFrame:
    """Groups whose aggregate, named value, does not meet the expression."""
    return df.groupBy(*by).agg(value.alias("value")).where(~F.coalesce(F.expr(expression), F.lit(False)))


def in_bucket(df: DataFrame, column: str, buckets: int, bucket: int) -> DataFrame:
    """Rows whose whole-number column leaves this remainder, for tests that look at a table one part at a time; null is in bucket 0."""
    return df.where(F.pmod(F.coalesce(F.col(column), F.lit(0)), F.lit(buckets)) == bucket)


def exclusive_ranges(df: DataFrame, lower: str, upper: str, by: str, gaps: bool = False, last: object = None) -> DataFrame:
    """Ranges that are empty, overlap the next one of their key, or, unless gaps may be, leave one before it; with last, also a key's last range that ends elsewhere."""
    df = df.withColumn("_next", F.lead(lower).over(Window.partitionBy(by).orderBy(lower, upper)))
    bad = (F.col(lower) >= F.col(upper)) | (F.col(upper) > F.col("_next"))
    bad = bad if gaps else bad | (F.col(upper) < F.col("_next"))
    bad = bad if last is None else F.coalesce(bad, F.lit(False)) | (F.col("_next").isNull() & (F.col(upper) != F.lit(last).cast(df.schema[upper].dataType)))
    return df.where(bad).drop("_next")


def at_least(df: DataFrame, larger: str, smaller: str) -> DataFrame:
    return df.where(F.col(larger) < F.col(smaller))


def same_count(a: DataFrame, b: DataFrame) -> DataFrame:
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(a, "n_a").crossJoin(n(b, "n_b")).where("n_a <> n_b")


def same_distinct_count(a: DataFrame, column_a: str, b: DataFrame, column_b: str, where: str | None = None) -> DataFrame:
    n = lambda df, c, name: df.agg(F.count_distinct(c).alias(name))
    return n(_where(a, where), column_a, "n_a").crossJoin(n(b, column_b, "n_b")).where("n_a <> n_b")


def reconciles(df: DataFrame, other: DataFrame, on: dict[str, str], differ: tuple[str, str]) -> DataFrame:
    """Rows for which other has a row of equal keys but a different value."""
    o = other.select(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(on.values())), F.col(differ[1]).alias("_ov"))
    cond = [F.col(c) == F.col(f"_o{i}") for i, c in enumerate(on)] + [F.col(differ[0]) != F.col("_ov")]
    return df.join(o, reduce(Column.__and__, cond), "left_semi")


def report(**tests: DataFrame) -> DataFrame:
    """(test, failures) for each test."""
    parts = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("test"), "failures") for name, df in tests.items()]
    return reduce(DataFrame.unionByName, parts)
