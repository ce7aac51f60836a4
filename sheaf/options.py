"""Options of decoding and encoding: immutable, checked when made."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column


@dataclass(frozen=True)
class Dates:
    """How text becomes an instant, and back."""

    kind: str
    pattern: str | None = None
    locale: str | None = None
    style: str = "numeric"
    function: Callable[[Column], Column] | None = None

    @classmethod
    def deferred(cls) -> Dates:
        return cls("deferred")

    @classmethod
    def seconds(cls) -> Dates:
        return cls("seconds")

    @classmethod
    def milliseconds(cls) -> Dates:
        return cls("milliseconds")

    @classmethod
    def iso8601(cls) -> Dates:
        return cls("iso8601")

    @classmethod
    def formatted(cls, pattern: str) -> Dates:
        return cls("formatted", pattern)

    @classmethod
    def flexible(cls, hint: str | None = None) -> Dates:
        return cls("flexible", hint)

    @classmethod
    def locale_aware(cls, locale: str, style: str = "numeric") -> Dates:
        if style not in ("numeric", "abbreviated", "long"):
            raise ValueError(f"unknown date style {style!r}")
        return cls("locale", locale=locale, style=style)

    @classmethod
    def custom(cls, function: Callable[[Column], Column]) -> Dates:
        return cls("custom", function=function)


@dataclass(frozen=True)
class Numbers:
    """How text becomes a double, float or decimal, and back. Integers ignore it."""

    kind: str
    locale: str | None = None
    code: str | None = None
    function: Callable[[Column], Column] | None = None

    @classmethod
    def standard(cls) -> Numbers:
        return cls("standard")

    @classmethod
    def flexible(cls) -> Numbers:
        return cls("flexible")

    @classmethod
    def localised(cls, locale: str) -> Numbers:
        return cls("locale", locale)

    @classmethod
    def parsed(cls, locale: str) -> Numbers:
        """Currency symbols and units are stripped, then the locale's notation is tried, then any."""
        return cls("parsed", locale)

    @classmethod
    def currency(cls, code: str | None, locale: str) -> Numbers:
        """As ``parsed``; the code is accepted and not used."""
        return cls("parsed", locale, code)

    @classmethod
    def custom(cls, function: Callable[[Column], Column]) -> Numbers:
        """For encoding."""
        return cls("custom", function=function)


@dataclass(frozen=True)
class Bools:
    kind: str
    true: tuple[str, ...] = ()
    false: tuple[str, ...] = ()

    @classmethod
    def standard(cls) -> Bools:
        return cls("standard")

    @classmethod
    def flexible(cls) -> Bools:
        return cls("flexible")

    @classmethod
    def custom(cls, true, false) -> Bools:
        """Sets of texts for decoding, or one text each for encoding."""
        as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return cls("custom", as_tuple(true), as_tuple(false))

    @classmethod
    def true_false(cls) -> Bools:
        return cls.custom("true", "false")

    @classmethod
    def numeric(cls) -> Bools:
        return cls.custom("1", "0")

    @classmethod
    def yes_no(cls) -> Bools:
        return cls.custom("yes", "no")


@dataclass(frozen=True)
class Nils:
    """Which texts are null, or which text null becomes."""

    kind: str
    values: tuple[str, ...] = ()

    @classmethod
    def empty(cls) -> Nils:
        return cls("empty")

    @classmethod
    def null_literal(cls) -> Nils:
        return cls("literal")

    @classmethod
    def custom(cls, *values: str) -> Nils:
        return cls("custom", tuple(values))


@dataclass(frozen=True)
class Keys:
    """How header names become field names (decoding) or field names header names (encoding)."""

    kind: str
    function: Callable[[str], str] | None = None

    @classmethod
    def default(cls) -> Keys:
        return cls("default")

    @classmethod
    def snake(cls) -> Keys:
        return cls("snake")

    @classmethod
    def kebab(cls) -> Keys:
        return cls("kebab")

    @classmethod
    def screaming(cls) -> Keys:
        return cls("screaming")

    @classmethod
    def pascal(cls) -> Keys:
        return cls("pascal")

    @classmethod
    def custom(cls, function: Callable[[str], str]) -> Keys:
        return cls("custom", function)


@dataclass(frozen=True)
class Nested:
    """Struct fields: refused, spread over prefixed columns, or JSON in one column."""

    kind: str
    separator: str = "_"

    @classmethod
    def error(cls) -> Nested:
        return cls("error")

    @classmethod
    def flatten(cls, separator: str = "_") -> Nested:
        return cls("flatten", separator)

    @classmethod
    def json(cls) -> Nested:
        return cls("json")

    #: The two are the same.
    codable = json


def _check_delimiter(delimiter: str) -> None:
    if len(delimiter) != 1 or not delimiter.isascii() or delimiter in '"\r\n':
        raise ValueError(f"a delimiter is one ASCII character other than quote, CR and LF, not {delimiter!r}")


@dataclass(frozen=True)
class DecodeOptions:
    delimiter: str = ","
    has_headers: bool = True
    encoding: str = "UTF-8"
    trim_whitespace: bool = True
    dates: Dates = Dates.deferred()
    numbers: Numbers = Numbers.standard()
    bools: Bools = Bools.standard()
    nils: Nils = Nils.empty()
    keys: Keys = Keys.default()
    column_mapping: Mapping[str, str] = field(default_factory=dict)
    index_mapping: Mapping[int, str] = field(default_factory=dict)
    #: "strict" refuses quotes in unquoted fields, text after a closing quote, and other field counts than expected.
    mode: str = "lenient"
    expected_field_count: int | None = None
    nested: Nested = Nested.error()
    #: "failfast" stops at a bad row, "permissive" gives nulls and an ``_errors`` column.
    on_error: str = "failfast"
    duplicate_headers: str = "last"

    def __post_init__(self) -> None:
        _check_delimiter(self.delimiter)
        for value, allowed in ((self.mode, ("lenient", "strict")), (self.on_error, ("failfast", "permissive")), (self.duplicate_headers, ("last", "error"))):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")
        if any(i < 0 for i in self.index_mapping):
            raise ValueError("column indexes start at 0")


@dataclass(frozen=True)
class EncodeOptions:
    delimiter: str = ","
    has_headers: bool = True
    dates: Dates = Dates.iso8601()
    nils: Nils = Nils.empty()
    keys: Keys = Keys.default()
    bools: Bools = Bools.numeric()
    numbers: Numbers = Numbers.standard()
    line_ending: str = "\n"
    nested: Nested = Nested.error()
    includes_trailing_newline: bool = False

    def __post_init__(self) -> None:
        _check_delimiter(self.delimiter)
        if self.line_ending not in ("\n", "\r\n"):
            raise ValueError("lines end with LF or CRLF")
        if len(self.nils.values) > 1:
            raise ValueError("null is written as one text")


@dataclass(frozen=True)
class ParallelOptions:
    """Hints; out-of-range values are clamped. Spark's own partitioning decides where none is given."""

    parallelism: int | None = None
    chunk_size: int = 1 << 20
    max_buffered_rows: int = 10_000
    preserve_order: bool = True

    def __post_init__(self) -> None:
        if self.parallelism is not None:
            object.__setattr__(self, "parallelism", max(1, self.parallelism))
        object.__setattr__(self, "chunk_size", max(64 << 10, self.chunk_size))
        object.__setattr__(self, "max_buffered_rows", max(100, self.max_buffered_rows))


@dataclass(frozen=True)
class MemoryOptions:
    """Limits of a streaming read; out-of-range values are clamped. The budget becomes bytes per trigger."""

    memory_budget: int = 50 << 20
    estimated_row_size: int = 256
    batch_size: int = 1000
    use_watermarks: bool = True
    high_watermark: float = 0.8
    low_watermark: float = 0.4

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("memory_budget", max(1 << 20, self.memory_budget))
        put("estimated_row_size", max(64, self.estimated_row_size))
        put("batch_size", max(1, self.batch_size))
        put("high_watermark", min(1.0, max(0.5, self.high_watermark)))
        put("low_watermark", min(self.high_watermark - 0.1, max(0.1, self.low_watermark)))

    @property
    def bytes_per_trigger(self) -> int:
        return int(self.memory_budget * (self.high_watermark if self.use_watermarks else 1))
