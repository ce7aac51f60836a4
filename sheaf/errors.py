"""Errors: exceptions on the driver, and the same as data in an error column, with suggested fixes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = T.StructType([T.StructField(n, T.LongType() if n == "row" else T.StringType()) for n in ("kind", "row", "column", "path", "expected", "actual", "message", "suggestion")])


@dataclass(frozen=True)
class Location:
    """Record number from 1 (the header counts), column name and path; available names do not count in comparisons."""

    row: int | None = None
    column: str | None = None
    path: tuple[str, ...] = ()
    available: tuple[str, ...] | None = field(default=None, compare=False)

    def __str__(self) -> str:
        parts = [f"row {self.row}"] if self.row is not None else []
        parts += [f"column '{self.column}'"] if self.column is not None else []
        parts += [f"path: {'.'.join(self.path)}"] if self.path else []
        return ", ".join(parts) or "unknown location"


class DecodingError(ValueError):
    pass


class EncodingError(ValueError):
    pass


class UnsupportedType(DecodingError, EncodingError, TypeError):
    """A shape that a row cannot hold; raised before any job."""

    def __init__(self, what: str):
        super().__init__(f"Unsupported operation: {what}")


class KeyNotFound(DecodingError):
    def __init__(self, key: str, location: Location):
        at = f" at {location}" if location.row is not None else ""
        hint = similar_key(key, location.available or ())
        super().__init__(f"Key '{key}' not found in CSV row{at}" + (f". {hint}" if hint else ""))
        self.key, self.location, self.suggestion = key, location, hint


class InvalidValue(EncodingError):
    pass


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar_key(key: str, names: Sequence[str]) -> str | None:
    """What the missing name may have been meant to be."""
    if not names:
        return None
    ranked = sorted((edit_distance(n.lower(), key.lower()), i) for i, n in enumerate(names))
    near = [(d, names[i]) for d, i in ranked if d <= max(3, len(key) // 2)]
    if near:
        distance, best = near[0]
        if distance == 0:
            return f"Did you mean '{best}'? (case differs)"
        if distance <= 2:
            return f"Did you mean '{best}'?"
        return "Similar columns available: " + ", ".join(f"'{n}'" for _, n in near[:3])
    return "Available columns: " + ", ".join(f"'{n}'" for n in names) if len(names) <= 5 else None


# Suggestions by expected type.
DECIMAL_TEXT = "Value appears to be a decimal. Use Double or Decimal type, or check for locale-specific formatting"
CURRENCY_TEXT = "Value contains currency symbol. Use numberDecodingStrategy: .flexible to strip currency symbols"
EUROPEAN_TEXT = "Value may use European number format (1.234,56). Use numberDecodingStrategy: .flexible or .locale(Locale)"
DATE_TEXT = 'Value appears to be a date. Use dateDecodingStrategy: .flexible for auto-detection, or .formatted("yyyy-MM-dd") for specific format'
TIMESTAMP_TEXT = "Value appears to be a timestamp. Use dateDecodingStrategy: .secondsSince1970 or .millisecondsSince1970"
QUOTES_TEXT = 'Check for unmatched quotes in the CSV data. Quotes inside fields should be escaped as ""'
DELIMITER_TEXT = "Try a different delimiter (e.g., semicolon ';' for European CSV, tab '\\t' for TSV)"
BOOLEAN_LIKE = ("yes", "no", "true", "false", "1", "0", "oui", "non", "ja", "nein", "да", "нет")
INTEGER_NAMES = frozenset(f"{sign}{bits}" for sign in ("Int", "UInt") for bits in ("", 8, 16, 32, 64))
REAL_NAMES = frozenset(("Decimal", "Double", "Float"))


def type_fix(expected: str, actual: Column) -> Column:
    """A suggestion for a value that is not of the expected type, or null."""
    none = F.lit(None).cast("string")
    has = lambda pattern: actual.rlike(pattern)
    if expected in INTEGER_NAMES:
        return F.when(has("[.,]"), DECIMAL_TEXT).when(has("[$€£]"), CURRENCY_TEXT).otherwise(none)
    if expected in REAL_NAMES:
        return F.when(has(",") & has(r"\."), EUROPEAN_TEXT).when(has("[$€£]"), CURRENCY_TEXT).otherwise(none)
    if expected == "Bool":
        return F.when(F.lower(actual).isin(*BOOLEAN_LIKE), F.concat(F.lit("Value '"), actual, F.lit("' is boolean-like. Use boolDecodingStrategy: .flexible for extended boolean values"))).otherwise(none)
    if expected == "Date":
        return F.when(has("[/.-]"), DATE_TEXT).when(actual.rlike(r"^[+-]?\d+(\.\d*)?$"), TIMESTAMP_TEXT).otherwise(none)
    return none


def parsing_fix(message: str) -> str | None:
    low = message.lower()
    if "unterminated" in low or "quote" in low:
        return QUOTES_TEXT
    return DELIMITER_TEXT if "delimiter" in low else None


def _error(kind: str, row: Column, column: str | None, path: tuple[str, ...], expected, actual, message: Column, suggestion) -> Column:
    text = lambda x: x.cast("string") if isinstance(x, Column) else F.lit(x).cast("string")
    suggestion = text(suggestion)
    full = F.concat(message, F.when(suggestion.isNotNull() & F.lit(kind != "parsingError"), F.concat(F.lit(". "), suggestion)).otherwise(F.lit("")))
    return F.struct(
        F.lit(kind).alias("kind"), row.cast("long").alias("row"), text(column).alias("column"), text(".".join(path) if path else None).alias("path"),
        text(expected).alias("expected"), text(actual).alias("actual"), full.alias("message"), suggestion.alias("suggestion"),
    )


def _place(row: Column, column: str | None, path: tuple[str, ...]) -> Column:
    after = (f", column '{column}'" if column is not None else "") + (f", path: {'.'.join(path)}" if path else "")
    return F.when(row.isNull(), F.lit("")).otherwise(F.concat(F.lit(" at row "), row.cast("string"), F.lit(after)))


def type_mismatch(expected: str, actual: Column, row: Column, column: str, path: tuple[str, ...], named: str | None = None) -> Column:
    message = F.concat(F.lit(f"Type mismatch: expected {expected}, found '"), actual, F.lit("'"), _place(row, column, path))
    return _error("typeMismatch", row, column, path, expected, actual, message, type_fix(named or expected, actual))


def key_not_found(key: str, row: Column, path: tuple[str, ...], names: Sequence[str]) -> Column:
    message = F.concat(F.lit(f"Key '{key}' not found in CSV row"), _place(row, key, path))
    return _error("keyNotFound", row, key, path, None, None, message, similar_key(key, names))


def parsing_error(message: str, row: Column, fixed: str | None = None) -> Column:
    text = F.concat(F.lit(f"Parsing error: {message}"), F.when(row.isNull(), F.lit("")).otherwise(F.concat(F.lit(" at line "), row.cast("string"))))
    return _error("parsingError", row, None, (), None, fixed, text, parsing_fix(message))
