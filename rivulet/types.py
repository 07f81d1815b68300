"""SQL types of declarations, and schemas as JSON."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: Largest precision and scale of DECIMAL; more is cut, with a warning.
MOST_PRECISION, MOST_SCALE = 38, 10

SIMPLE = {
    "BOOLEAN": T.BooleanType, "BOOL": T.BooleanType,
    "TINYINT": T.ByteType, "SMALLINT": T.ShortType, "INT2": T.ShortType,
    "INTEGER": T.IntegerType, "INT": T.IntegerType, "INT4": T.IntegerType, "SIGNED": T.IntegerType,
    "BIGINT": T.LongType, "INT8": T.LongType, "INT64": T.LongType, "UINT64": T.LongType,
    "FLOAT": T.FloatType, "REAL": T.FloatType, "FLOAT32": T.FloatType,
    "DOUBLE": T.DoubleType, "FLOAT64": T.DoubleType,
    "CHAR": T.StringType, "VARCHAR": T.StringType, "STRING": T.StringType, "TEXT": T.StringType, "CHARACTER": T.StringType,
    "DATE": T.DateType, "TIMESTAMP": T.TimestampNTZType, "NULL": T.NullType,
}
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_TYPE = re.compile(r"^\s*(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*(.*)$", re.S)


class UnsupportedType(ValueError):
    """A type that tables can't have."""


def parse_type(text: str, warn=lambda message: None) -> T.DataType:
    """INT, DECIMAL(10, 2), VARCHAR(5) ARRAY, ... -> a Spark type. Lengths of strings and precision of times are not enforced."""
    m = _TYPE.match(text)
    if not m:
        raise UnsupportedType(text)
    name, p, s, rest = m[1].upper(), m[2], m[3], m[4].strip().upper()
    if name == "DOUBLE" and rest.startswith("PRECISION"):
        rest = rest.removeprefix("PRECISION").strip()
    if name in ("DECIMAL", "NUMERIC", "DEC"):
        precision = MOST_PRECISION if p is None else int(p)
        scale = (MOST_SCALE if p is None else 0) if s is None else int(s)
        if precision > MOST_PRECISION or scale > MOST_SCALE:
            warn(f"{text.strip()}: precision is cut to {MOST_PRECISION}, scale to {MOST_SCALE}")
        kind = T.DecimalType(min(precision, MOST_PRECISION), min(scale, MOST_SCALE))
    elif name == "GEOMETRY":
        kind = POINT
    elif name in SIMPLE:
        kind = SIMPLE[name]()
    else:
        raise UnsupportedType(f"type {text.strip()} can't be declared")
    while rest.startswith("ARRAY"):
        kind, rest = T.ArrayType(kind), rest.removeprefix("ARRAY").strip()
    if rest:
        raise UnsupportedType(f"{rest} isn't understood in type {text.strip()}")
    return kind


def type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.ArrayType):
        return f"{type_name(kind.elementType)} ARRAY"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision}, {kind.scale})"
    if kind == POINT:
        return "GEOMETRY"
    known = {T.StringType: "VARCHAR", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "TINYINT", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP", T.DoubleType: "DOUBLE", T.FloatType: "REAL", T.BooleanType: "BOOLEAN", T.DateType: "DATE"}
    return known.get(type(kind), kind.simpleString().upper())


def schema_json(name: str, schema: T.StructType) -> dict:
    return {"name": name, "fields": [{"name": f.name, "type": type_name(f.dataType), "nullable": f.nullable} for f in schema]}
