"""Values to text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema as S
from sheaf.errors import UnsupportedType
from sheaf.functions import locales as L
from sheaf.options import Dates, EncodeOptions, Numbers


def plain_real(x: Column, dtype: T.DataType) -> Column:
    """Shortest digits that read back as the same number, never with an exponent."""
    text = x.cast("string")
    shift = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(text, "E.*$", ""), r"[.-]", "")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(digits, r"(?<=\d)0+$", "")
    whole = F.concat(F.rpad(digits, F.greatest(shift + 1, F.length(digits)), "0"))
    big = F.concat(sign, F.substring(whole, F.lit(1), shift + 1), F.lit("."), F.when(F.length(whole) > shift + 1, F.substring(whole, shift + 2, F.length(whole))).otherwise(F.lit("0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -shift - 1), digits)
    return F.when(text.contains("E"), F.when(shift >= 0, big).otherwise(small)).otherwise(text)


def grouped(x: Column, locale: str) -> Column:
    """Grouped by threes, as many decimals as the value has, in the locale's separators."""
    n = L.notation(locale)
    text = plain_real(x.cast("double"), T.DoubleType()) if not isinstance(x, str) else x
    whole = F.regexp_extract(text, r"^-?(\d+)", 1)
    rest = F.regexp_replace(F.regexp_extract(text, r"\.(\d+)$", 1), "0+$", "")
    sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    mark = " " if n.grouping == " " else n.grouping
    whole = F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", mark)
    return F.concat(sign, whole, F.when(rest == "", F.lit("")).otherwise(F.concat(F.lit(n.decimal), rest)))


def decimal_text(x: Column) -> Column:
    text = F.regexp_replace(x.cast("string"), r"^(-?)(0E-\d+)$", "0")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def date_text(x: Column, how: Dates) -> Column:
    if how.kind == "seconds":
        return plain_real(F.unix_micros(x) / 1_000_000, T.DoubleType())
    if how.kind == "milliseconds":
        return plain_real(F.unix_micros(x) / 1_000, T.DoubleType())
    if how.kind == "iso8601":
        # An instant ends in Z, so it is written in UTC whatever the session's zone.
        utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.unix_micros(x) / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
        return F.concat(F.replace(F.substring(utc.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))
    if how.kind == "formatted":
        return F.date_format(x, how.pattern)
    if how.kind == "custom":
        return how.function(x)
    raise UnsupportedType("a timestamp field needs a date strategy")


def number_text(x: Column, how: Numbers, dtype: T.DataType) -> Column:
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    if how.kind == "custom":
        text = how.function(x)
    elif how.kind == "locale":
        text = grouped(x, how.locale)
    else:
        text = plain_real(x.cast("double") if isinstance(dtype, T.FloatType) else x, dtype)
    return F.when(bad, F.raise_error(F.concat(F.lit("Invalid value: cannot encode "), x.cast("string")))).otherwise(text)


def sorted_keys(x: Column, dtype: T.DataType) -> Column:
    """The same value with struct fields in the order of their names."""
    if isinstance(dtype, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[sorted_keys(x[f.name], f.dataType).alias(S.column_name(f)) for f in sorted(dtype.fields, key=S.column_name)]))
    if isinstance(dtype, T.ArrayType) and S.is_nested(dtype.elementType):
        return F.transform(x, lambda e: sorted_keys(e, dtype.elementType))
    return x


def text(x: Column, field: T.StructField, options: EncodeOptions) -> Column:
    """The text of a value; null stays null."""
    dtype = field.dataType
    if isinstance(dtype, T.BooleanType):
        true, false = {"standard": (("1",), ("0",))}.get(options.bools.kind, (options.bools.true, options.bools.false))
        return F.when(x, F.lit(true[0])).when(~x, F.lit(false[0]))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return number_text(x, options.numbers, dtype)
    if isinstance(dtype, T.DecimalType):
        return decimal_text(x)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return date_text(x.cast("timestamp"), options.dates)
    if isinstance(dtype, T.StringType):
        return F.upper(x) if field.metadata.get(S.KIND) == "uuid" else x
    if isinstance(dtype, T.IntegralType):
        return x.cast("string")
    if S.is_nested(dtype) and options.nested.kind == "json":
        return F.to_json(sorted_keys(x, dtype))
    raise UnsupportedType(f"{field.name}: {dtype.simpleString()} in a row")
