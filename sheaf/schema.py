"""Record types: dataclasses to Spark schemas, and the walk over nested fields."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import types
import typing
import uuid
from collections.abc import Iterator
from typing import Annotated, Any, NewType

from pyspark.sql import types as T

#: Texts that are checked on decoding; their column is a string.
UUID = uuid.UUID
URL = NewType("URL", str)

#: Metadata keys of schema fields.
NAME, KIND, VALUES = "csv", "csv_kind", "csv_values"

#: Integer kinds beyond Spark's own: bounds and the Spark type that holds them.
UNSIGNED = {"uint8": (255, T.ShortType()), "uint16": (65_535, T.IntegerType()), "uint32": (4_294_967_295, T.LongType()), "uint64": (18_446_744_073_709_551_615, T.DecimalType(20, 0))}

_TYPES: dict[Any, T.DataType] = {
    bool: T.BooleanType(), str: T.StringType(), int: T.LongType(), float: T.DoubleType(), decimal.Decimal: T.DecimalType(38, 18),
    datetime.datetime: T.TimestampType(), UUID: T.StringType(), URL: T.StringType(),
}
_KINDS = {UUID: "uuid", URL: "url"}


def csv_column(name: str, **options: Any) -> Any:
    """A dataclass field with a column name of its own."""
    return dataclasses.field(metadata={NAME: name}, **options)


def kind(name: str) -> dict[str, str]:
    """Metadata for a schema field: uint8 to uint64, uuid or url."""
    return {KIND: name}


def _field(name: str, annotation: Any, metadata: dict) -> T.StructField:
    nullable = False
    extra = {k: v for k, v in metadata.items() if k in (NAME, KIND, VALUES)}
    if typing.get_origin(annotation) is Annotated:
        annotation, *notes = typing.get_args(annotation)
        for note in notes:
            if isinstance(note, T.DataType):
                return T.StructField(name, note, nullable, extra)
            extra[KIND] = note
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        inner = [a for a in typing.get_args(annotation) if a is not type(None)]
        if len(inner) != 1 or len(typing.get_args(annotation)) != 2:
            raise TypeError(f"{name}: only X | None unions are supported")
        inner_field = _field(name, inner[0], metadata)
        return T.StructField(name, inner_field.dataType, True, inner_field.metadata)
    if isinstance(annotation, type) and dataclasses.is_dataclass(annotation):
        return T.StructField(name, schema_of(annotation), nullable, extra)
    if annotation in _KINDS:
        extra[KIND] = _KINDS[annotation]
    if extra.get(KIND) in UNSIGNED:
        return T.StructField(name, UNSIGNED[extra[KIND]][1], nullable, extra)
    origin = typing.get_origin(annotation)
    if origin in (list, dict):
        parts = [_field("x", a, {}) for a in typing.get_args(annotation)]
        made = T.ArrayType(parts[0].dataType, parts[0].nullable) if origin is list else T.MapType(parts[0].dataType, parts[1].dataType, parts[1].nullable)
        return T.StructField(name, made, nullable, extra)
    if annotation not in _TYPES:
        raise TypeError(f"{name}: unsupported type {annotation!r}")
    return T.StructField(name, _TYPES[annotation], nullable, extra)


def schema_of(record: type) -> T.StructType:
    """The schema of a dataclass: stored fields in order, ``X | None`` nullable; properties are left out."""
    if not dataclasses.is_dataclass(record):
        raise TypeError(f"{record!r} is not a dataclass")
    hints = typing.get_type_hints(record, include_extras=True)
    return T.StructType([_field(f.name, hints[f.name], dict(f.metadata)) for f in dataclasses.fields(record)])


def csv_indexed(record: type) -> type:
    """Class decorator: makes a dataclass whose field order is the column order, with ``csv_schema`` and ``csv_columns``."""
    if not isinstance(record, type):
        raise TypeError("csv_indexed applies to classes")
    made = record if dataclasses.is_dataclass(record) else dataclasses.dataclass(frozen=True)(record)
    made.csv_schema = schema_of(made)
    made.csv_columns = [column_name(f) for f in made.csv_schema.fields]
    return made


def as_schema(schema: T.StructType | type | str) -> T.StructType:
    if isinstance(schema, str):
        return T.StructType.fromDDL(schema)
    return schema if isinstance(schema, T.StructType) else schema_of(schema)


def column_name(field: T.StructField) -> str:
    return field.metadata.get(NAME, field.name)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType))


def leaves(schema: T.StructType, separator: str, prefix: str = "") -> Iterator[tuple[str, tuple[str, ...], T.StructField]]:
    """(flat name, path, field) of all leaf fields, structs spread over prefixed names."""
    for f in schema.fields:
        name = prefix + column_name(f)
        if isinstance(f.dataType, T.StructType):
            for flat, path, leaf in leaves(f.dataType, separator, name + separator):
                yield flat, (f.name, *path), leaf
        else:
            yield name, (f.name,), f
