"""Scalar functions over columns: keys, dates and arithmetic whose results other engines must share."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They are part of stored keys and intervals.
NULL_KEY = "_dbt_utils_surrogate_key_null_"
NULL_PAYLOAD = "_null_"
LOW = datetime(1900, 1, 1)
HIGH = datetime(9999, 12, 31, 23, 59, 59, 999999)
UNKNOWN_ID = "-1"

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def timestamp_text(c: ColumnLike) -> Column:
    """A timestamp with all six digits; a plain cast drops trailing zeros."""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def key_text(c: ColumnLike, kind: T.DataType | None = None) -> Column:
    """A value's text in keys. Timestamps need their type to be told, since a column does not know it."""
    return timestamp_text(c) if isinstance(kind, T.TimestampType | T.TimestampNTZType) else col(c).cast("string")


def surrogate_key(*cols: ColumnLike, timestamps: tuple[ColumnLike, ...] = ()) -> Column:
    """MD5 of the values' texts joined with ``-``, nulls replaced; timestamps follow the other columns."""
    texts = [col(c).cast("string") for c in cols] + [timestamp_text(c) for c in timestamps]
    parts: list[Column] = []
    for t in texts:
        parts += [F.lit("-"), F.coalesce(t, F.lit(NULL_KEY))]
    return F.md5(F.concat(*parts[1:]))


row_hash = surrogate_key


def payload_hash(df: DataFrame, cols: list[str] | None = None) -> Column:
    """MD5 over source columns in file order, joined with a double pipe; its delimiter and null differ from a key's."""
    parts: list[Column] = []
    for f in df.schema.fields:
        if cols is None or f.name in cols:
            parts += [F.lit("||"), F.coalesce(key_text(F.col(f"`{f.name}`"), f.dataType), F.lit(NULL_PAYLOAD))]
    return F.md5(F.concat(*parts[1:])) if parts else F.md5(F.lit(""))


def unknown_key() -> Column:
    return F.md5(F.lit(UNKNOWN_ID))


def low() -> Column:
    return F.lit("1900-01-01 00:00:00").cast("timestamp_ntz")


def high() -> Column:
    return F.lit("9999-12-31 23:59:59.999999").cast("timestamp_ntz")


def date_key(c: ColumnLike) -> Column:
    """yyyymmdd as an integer; null for null."""
    return (F.year(col(c)) * 10000 + F.month(col(c)) * 100 + F.dayofmonth(col(c))).cast("int")


def from_date_key(c: ColumnLike) -> Column:
    return F.to_date(col(c).cast("string"), "yyyyMMdd")


def end_of_day(c: ColumnLike) -> Column:
    """The last microsecond of a date."""
    return F.concat(col(c).cast("date").cast("string"), F.lit(" 23:59:59.999999")).cast("timestamp_ntz")


def seconds_between(a: ColumnLike, b: ColumnLike) -> Column:
    """Whole seconds from a to b, cut towards zero."""
    return F.timestamp_diff("SECOND", col(a), col(b))


def iso_weekday(c: ColumnLike) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(col(c)) + 1


def int_div(a: ColumnLike, b: int) -> Column:
    """Whole part of a division of whole numbers."""
    return F.floor(col(a) / F.lit(b)).cast("int")


def _strict(f, cols: tuple[ColumnLike, ...]) -> Column:
    missing = col(cols[0]).isNull()
    for c in cols[1:]:
        missing = missing | col(c).isNull()
    return F.when(~missing, f(*map(col, cols)))


def strict_greatest(*cols: ColumnLike) -> Column:
    """greatest that is null if any value is; the built-in one skips nulls."""
    return _strict(F.greatest, cols)


def strict_least(*cols: ColumnLike) -> Column:
    return _strict(F.least, cols)


def capped_ratio(part: ColumnLike, whole: ColumnLike, cap: float = 1.0, kind: str = "decimal(5,4)") -> Column:
    """part / whole in double precision, at most cap, as a decimal; null if the whole is null or zero."""
    return strict_least(F.try_divide(col(part).cast("double"), col(whole).cast("double")), F.lit(cap)).cast(kind)


def checksum(df: DataFrame, without: tuple[str, ...] = ("loaded_at",)) -> DataFrame:
    """One row that tells tables apart whatever their rows' order: count, xor and sum of row hashes. Audit columns are left out."""
    cols = [F.col(f"`{c}`") for c in df.columns if c not in without]
    h = F.xxhash64(*cols)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))
