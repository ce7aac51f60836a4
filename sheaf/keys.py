"""Names of columns: header transforms and header resolution. Runs on the driver, on names alone."""

from __future__ import annotations

import re
from collections.abc import Sequence

from sheaf.options import DecodeOptions, Keys


def _capitalised(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


def _joined(words: Sequence[str]) -> str:
    words = [w for w in words if w]
    return "".join([words[0].lower(), *map(_capitalised, words[1:])]) if words else ""


def decoded_key(name: str, keys: Keys) -> str:
    """A field name for a header name."""
    if keys.kind == "snake":
        return _joined(name.split("_")) or name
    if keys.kind == "kebab":
        return _joined(name.split("-")) or name
    if keys.kind == "screaming":
        return _joined(name.lower().split("_")) or name
    if keys.kind == "pascal":
        return name[:1].lower() + name[1:]
    return keys.function(name) if keys.kind == "custom" else name


def encoded_key(name: str, keys: Keys) -> str:
    """A header name for a field name: a separator before every capital but the first character."""
    separated = lambda mark: re.sub(r"(?<!^)(?=[^\W\d_a-z])(?=\w)", mark, name) if name != name.lower() else name
    if keys.kind == "snake":
        return separated("_").lower()
    if keys.kind == "kebab":
        return separated("-").lower()
    if keys.kind == "screaming":
        return separated("_").upper()
    if keys.kind == "pascal":
        return name[:1].upper() + name[1:]
    return keys.function(name) if keys.kind == "custom" else name


def resolved(header: Sequence[str] | None, fields: Sequence[str] | None, width: int, options: DecodeOptions) -> list[str]:
    """The name of each column: index mapping, else the header, else the schema's order, else column0, column1, ..."""
    if options.index_mapping:
        return [options.index_mapping.get(i, f"column{i}") for i in range(max(options.index_mapping) + 1)]
    if header is not None:
        names = [h.strip() if options.trim_whitespace else h for h in header]
        return [options.column_mapping.get(n) or decoded_key(n, options.keys) for n in names]
    if fields is not None:
        return list(fields)
    return [f"column{i}" for i in range(width)]


def positions(names: Sequence[str], on_duplicates: str = "last") -> dict[str, int]:
    """Name to column; of equal names the last counts, unless that is refused."""
    if on_duplicates == "error" and len(set(names)) < len(names):
        raise ValueError(f"duplicate column names: {sorted({n for n in names if names.count(n) > 1})}")
    return {name: i for i, name in enumerate(names)}
