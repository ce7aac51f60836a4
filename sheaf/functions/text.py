"""Fields and records as text: trimming, escaping, splitting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a Java regular expression calls horizontal white space: Unicode spaces and the tab, no line ends.
_EDGES = r"^[\h]+|[\h]+$"


def trimmed(field: Column) -> Column:
    return F.regexp_replace(field, _EDGES, "")


def needs_quoting(field: Column, delimiter: str = ",") -> Column:
    return field.contains(delimiter) | field.contains('"') | field.contains("\r") | field.contains("\n")


def escaped(field: Column, delimiter: str = ",") -> Column:
    """The field as it stands in a record; null stays null."""
    quoted = F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(needs_quoting(field, delimiter), quoted).otherwise(field)


def unescaped(field: Column) -> Column:
    """A raw field's value: quotes around it go, doubled quotes inside become one."""
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inner).otherwise(field)


def _written_field(d: str) -> str:
    return f'(?:"(?:[^"]++|"")*+"(?:[^{d}"\\r\\n][^{d}\\r\\n]*+)?|[^{d}"\\r\\n][^{d}\\r\\n]*+|)'


def record_pattern(delimiter: str) -> str:
    """One record with its terminator, at the end of the last match."""
    d = re.escape(delimiter)
    field = _written_field(d)
    return f"\\G({field}(?:{d}{field})*+(?:\\r\\n|\\n|\\r|\\z))"


def is_record(line: Column, delimiter: str) -> Column:
    """Whether what lies between two line feeds is one record."""
    d = re.escape(delimiter)
    field = _written_field(d)
    return F.when(~line.contains('"') & ~line.contains("\r"), True).otherwise(line.rlike(f"\\A{field}(?:{d}{field})*+\\r?\\z"))


def closes(line: Column, delimiter: str, inside: bool) -> Column:
    """Whether no quoted field is open at the end of a line that begins outside of quotes or ``inside``."""
    d = re.escape(delimiter)
    field = _written_field(d)
    shape = f"\\A{field}(?:(?:{d}|\\r){field})*+\\z"
    text = F.concat(F.lit('"'), line) if inside else line
    return F.when(~line.contains('"'), not inside).otherwise(text.rlike(shape))


def field_pattern(delimiter: str) -> str:
    """One field with the delimiter before it, or the text after a closing quote, of a record with a delimiter put before."""
    d = re.escape(delimiter)
    return f'({d}(?:"(?:[^"]++|"")*+"|[^{d}]*+)|[^{d}]++)'


def split(content: Column, delimiter: str) -> Column:
    """All records of a document with their terminators, as far as quotes are closed, and what an empty match ends them with."""
    return F.regexp_extract_all(content, F.lit(record_pattern(delimiter)), F.lit(1))


def records(found: Column) -> Column:
    """Of a document's split its records. An empty last line is none; one in between is."""
    # A split that reaches the end closes with an empty match there; one that stops at an unclosed quote does not.
    whole = F.try_element_at(found, F.lit(-1)) == ""
    blank = F.try_element_at(found, F.lit(-2)).isin("\n", "\r", "\r\n")
    return F.when(whole, F.slice(found, F.lit(1), F.size(found) - F.when(blank, 2).otherwise(1))).otherwise(found)


def consumed(found: Column) -> Column:
    """How many characters the split holds; fewer than the content where a quote is not closed."""
    return F.aggregate(found, F.lit(0), lambda total, x: total + F.length(x))


def raw_fields(record: Column, delimiter: str) -> Column:
    """The fields of a record as written, quotes included."""
    body = F.concat(F.lit(delimiter), F.regexp_replace(record, r"(?:\r\n|\n|\r)\z", ""))
    found = F.regexp_extract_all(body, F.lit(field_pattern(delimiter)), F.lit(1))
    return F.transform(found, lambda x: F.when(x.startswith(delimiter), F.substring(x, F.lit(2), F.length(x))).otherwise(x))
