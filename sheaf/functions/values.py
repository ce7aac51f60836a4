"""Text to values, as column expressions. Each parser gives null where the text is not a value."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf import schema as S
from sheaf.errors import UnsupportedType
from sheaf.functions import locales as L
from sheaf.options import Bools, Dates, DecodeOptions, Nils, Numbers

# The reference names of types, as messages have them.
NAMES = {T.BooleanType: "Bool", T.StringType: "String", T.LongType: "Int", T.IntegerType: "Int32", T.ShortType: "Int16", T.ByteType: "Int8", T.DoubleType: "Double", T.FloatType: "Float", T.DecimalType: "Decimal", T.TimestampType: "Date", T.TimestampNTZType: "Date"}
KIND_NAMES = {"uint8": "UInt8", "uint16": "UInt16", "uint32": "UInt32", "uint64": "UInt64", "uuid": "UUID", "url": "URL"}

#: Gives an expression a name where it is mentioned more than once, so that it is computed once.
Bind = Callable[[Column], Column]

INTEGER = r"^[+-]?[0-9]+$"
REAL = r"(?i)^[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?|\.[0-9]+(?:e[+-]?[0-9]+)?|inf|infinity|nan|0x[0-9a-f]+\.?[0-9a-f]*(?:p[+-]?[0-9]+)?)$"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
UUID = r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"


def is_null(text: Column, nils: Nils) -> Column:
    if nils.kind == "literal":
        return (text == "") | (F.lower(text) == "null")
    return text.isin("", *nils.values) if nils.kind == "custom" else text == ""


def boolean(text: Column, how: Bools) -> Column:
    low = F.lower(text)
    true, false = L.TRUE_TEXTS, L.FALSE_TEXTS
    if how.kind == "custom":
        true, false = [x.lower() for x in how.true], [x.lower() for x in how.false]
    elif how.kind == "flexible":
        true, false = true + L.MORE_TRUE_TEXTS, false + L.MORE_FALSE_TEXTS
    found = F.when(low.isin(*true), True).when(low.isin(*false), False)
    if how.kind == "flexible":
        found = found.otherwise(F.when(text.rlike(INTEGER), text.try_cast("bigint") != 0))
    return found


def integer(text: Column, dtype: T.DataType, kind: str | None = None) -> Column:
    if kind in S.UNSIGNED:
        most, dtype = S.UNSIGNED[kind]
        wide = text.try_cast("decimal(38,0)")
        return F.when(text.rlike(INTEGER) & wide.between(F.lit(0).cast("decimal(38,0)"), F.lit(str(most)).cast("decimal(38,0)")), wide).cast(dtype)
    return F.when(text.rlike(INTEGER), text.try_cast(dtype))


def stripped(text: Column) -> Column:
    """Without a unit of measure at the end, then without currency symbols."""
    plain, given = text.rlike(r"^[0-9.,+\-]*$"), text  # has neither
    text = F.regexp_replace(text, r"^[\s\h]+|[\s\h]+$", "")
    long_units = "|".join(u for u in L.UNITS if len(u) > 1)
    text = F.regexp_replace(text, rf"(?i) (?:{'|'.join(L.UNITS)})$|(?<=[0-9.,])\h*(?:{long_units})$", "")
    letters = "".join(L.LETTER_SYMBOLS)
    many = "|".join(re.escape(s) for s in sorted(L.SYMBOLS, key=len, reverse=True))
    text = F.regexp_replace(text, rf"(?iu){many}", "")
    text = F.regexp_replace(text, rf"^[{letters}]\h*(?=[0-9-])|(?<=[0-9])\h*[{letters}]$", "")
    return F.when(plain, given).otherwise(F.regexp_replace(text, r"^\h+|\h+$", ""))


def normalised(text: Column) -> Column:
    """Of a stripped number of unknown notation, digits with a decimal point; null if nothing is left."""
    dot, comma = F.instr(text, "."), F.instr(text, ",")
    last_dot, last_comma = F.length(text) - F.instr(F.reverse(text), "."), F.length(text) - F.instr(F.reverse(text), ",")
    parts = F.filter(F.split(text, ","), lambda x: x != "")
    as_point = F.translate(F.replace(text, F.lit("."), F.lit("")), ",", ".")
    no_comma = F.replace(text, F.lit(","), F.lit(""))
    short = (F.size(parts) == 2) & (F.length(F.try_element_at(parts, F.lit(2))) <= 2)
    chosen = (
        F.when((dot > 0) & (comma > 0), F.when(last_comma > last_dot, as_point).otherwise(no_comma))
        .when(comma > 0, F.when(short, F.translate(text, ",", ".")).otherwise(no_comma))
        .otherwise(text)
    )
    return F.nullif(F.regexp_replace(chosen, r"[^0-9.\-]", ""), F.lit(""))


def localised(text: Column, locale: str) -> Column:
    """A number in the locale's notation with a decimal point instead; null where it is not in that notation."""
    n = L.notation(locale)
    grouping = r"[   ]" if n.grouping == " " else re.escape(n.grouping)
    decimal = re.escape(n.decimal)
    shape = rf"^[+-]?(?:[0-9]{{1,3}}(?:{grouping}[0-9]{{3}})+|[0-9]+)(?:{decimal}[0-9]*)?$|^[+-]?{decimal}[0-9]+$"
    plain = F.regexp_replace(F.regexp_replace(text, grouping, ""), decimal, ".")
    return F.when(text.rlike(shape), plain)


def number_text(text: Column, how: Numbers, bind: Bind = lambda x: x) -> Column:
    if how.kind == "standard":
        return text
    if how.kind == "locale":
        return bind(localised(text, how.locale))
    clean = bind(stripped(text))
    if how.kind == "flexible":
        return bind(normalised(clean))
    return bind(F.coalesce(localised(clean, how.locale), normalised(clean)))


def real(text: Column, how: Numbers, dtype: T.DataType, bind: Bind = lambda x: x) -> Column:
    text = number_text(text, how, bind)
    return F.when(text.rlike(REAL), text.try_cast("double")).cast(dtype)


def decimal(text: Column, how: Numbers, dtype: T.DecimalType, bind: Bind = lambda x: x) -> Column:
    text = number_text(text, how, bind)
    return F.when(text.rlike(DECIMAL), text.try_cast(dtype))


def _epoch(text: Column, scale: int) -> Column:
    seconds = F.when(text.rlike(REAL), text.try_cast("double"))
    micros = F.round(seconds * scale)
    return F.when(F.abs(micros) < 9e18, F.timestamp_micros(F.when(F.abs(micros) < 9e18, micros).cast("bigint")))


def _try(text: Column, *patterns: str) -> Column:
    """The first pattern that fits; an offset letter Z also takes a literal Z and +hh:mm."""
    arms = []
    for p in patterns:
        arms += [p[:-1] + "XXX", p] if p.endswith("Z") else [p]
    return F.coalesce(*[F.when(text.like(_outline(p)), F.try_to_timestamp(text, F.lit(p))) for p in arms])


def _outline(pattern: str) -> str:
    """What any text of a date pattern is like: its punctuation in order. Parsing a text that is not costs an exception."""
    return re.sub(r"[^-/.:, ]+", "%", re.sub(r"'[^']*'", "%", pattern))


def _relative(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low == "today", F.current_date().cast("timestamp")).when(low == "yesterday", F.date_sub(F.current_date(), 1).cast("timestamp"))


def instant(text: Column, how: Dates, bind: Bind = lambda x: x) -> Column:
    if how.kind == "deferred":
        raise UnsupportedType("a timestamp field needs a date strategy")
    if how.kind == "seconds":
        return _epoch(text, 1_000_000)
    if how.kind == "milliseconds":
        return _epoch(text, 1_000)
    if how.kind == "iso8601":
        return _try(text, "yyyy-MM-dd'T'HH:mm:ssZ", "yyyy-MM-dd'T'HH:mm:ss.SSSZ")
    if how.kind == "formatted":
        return _try(text, how.pattern)
    if how.kind == "custom":
        return how.function(text)
    clean = bind(F.regexp_replace(text, r"^[\s\h]+|[\s\h]+$", ""))
    flexible = [_try(clean, *L.DATE_PATTERNS), _relative(clean)]
    if how.kind == "locale":
        patterns = getattr(L.notation(how.locale), how.style)
        return F.coalesce(_try(clean, *patterns, *(f"{p}{s} {t}" for p in patterns for s in ("", ",") for t in ("h:mm a", "HH:mm"))), *flexible)
    return F.coalesce(*([_try(clean, how.pattern)] if how.pattern else []), *flexible)


def expected_name(dtype: T.DataType, kind: str | None, dates: Dates) -> tuple[str, str]:
    """What a message calls the type, and the name that suggestions go by."""
    name = KIND_NAMES.get(kind) or NAMES.get(type(dtype), dtype.simpleString())
    if name != "Date":
        return name, name
    text = {"seconds": "Unix timestamp", "milliseconds": "Unix timestamp (ms)", "iso8601": "ISO8601 date", "formatted": f"Date with format {dates.pattern}", "locale": "Date (locale-aware)"}.get(dates.kind, "Date (no matching format found)")
    return text, name


def value(text: Column, field: T.StructField, options: DecodeOptions, bind: Bind = lambda x: x) -> Column:
    """The value of a present, non-null text; null where it is not one. ``text`` is mentioned more than once."""
    dtype, kind = field.dataType, field.metadata.get(S.KIND)
    if isinstance(dtype, T.BooleanType):
        found = boolean(text, options.bools)
    elif kind in S.UNSIGNED or isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        found = integer(text, dtype, kind)
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        found = real(text, options.numbers, dtype, bind)
    elif isinstance(dtype, T.DecimalType):
        found = decimal(text, options.numbers, dtype, bind)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        found = instant(text, options.dates, bind).cast(dtype)
    elif isinstance(dtype, T.StringType):
        found = text
        if kind == "uuid":
            found = F.when(text.rlike(UUID), F.upper(text))
        elif kind == "url":
            found = F.when((text != "") & F.try_parse_url(text, F.lit("PATH")).isNotNull(), text)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) and options.nested.kind == "json":
        found = F.from_json(text, dtype, {"mode": "PERMISSIVE"})
    else:
        raise UnsupportedType(f"{field.name}: {dtype.simpleString()} in a row")
    if S.VALUES in field.metadata:
        found = F.when(found.isin(*field.metadata[S.VALUES]), found)
    return found
