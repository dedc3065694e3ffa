"""Text forms and number coercions: every cell reads as text, and the empty text is the only "null"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def text_of(df: DataFrame, name: str) -> Column:
    """The text form of a column, never null: whole doubles print without a fraction, times as UTC with milliseconds."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        out = c
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        out = F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSS")
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        out = F.to_json(c)
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def number(text: Column) -> Column:
    """Strict number of a whole text: decimal with exponent, or hexadecimal; null otherwise (and for the empty text)."""
    t = F.trim(text)
    decimal = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    return F.coalesce(decimal, F.when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 20), 16, 10).try_cast("double")))


def leading_number(text: Column) -> Column:
    """Number that a text begins with (``12abc`` is 12); null if none."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double")
