"""GoogleSQL types: names to Spark DDL, REST schemas to StructType, Spark types and values to REST."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
import math

from pyspark.sql import types as T

from ..errors import Invalid

SCALARS = {
    "INT64": "BIGINT", "INT": "BIGINT", "SMALLINT": "BIGINT", "INTEGER": "BIGINT", "BIGINT": "BIGINT", "TINYINT": "BIGINT", "BYTEINT": "BIGINT",
    "FLOAT64": "DOUBLE", "FLOAT": "DOUBLE", "DOUBLE": "DOUBLE", "NUMERIC": "DECIMAL(38,9)", "DECIMAL": "DECIMAL(38,9)", "BIGNUMERIC": "DECIMAL(38,18)", "BIGDECIMAL": "DECIMAL(38,18)",
    "BOOL": "BOOLEAN", "BOOLEAN": "BOOLEAN", "STRING": "STRING", "BYTES": "BINARY", "DATE": "DATE", "TIME": "TIME(6)", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP", "JSON": "VARIANT",
}

_SPARK = {
    "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "DECIMAL(38,9)": T.DecimalType(38, 9), "DECIMAL(38,18)": T.DecimalType(38, 18), "BOOLEAN": T.BooleanType(), "STRING": T.StringType(),
    "BINARY": T.BinaryType(), "DATE": T.DateType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "TIMESTAMP": T.TimestampType(), "VARIANT": T.VariantType(), "TIME(6)": T.TimeType(6),
}


def scalar(name: str) -> str:
    try:
        return SCALARS[name.upper()]
    except KeyError:
        raise Invalid(f"Unsupported type: {name}") from None


def field_type(f: dict) -> T.DataType:
    """Spark type of a REST field: REPEATED wraps in an array, RECORD nests."""
    kind = f.get("type", "STRING").upper()
    t: T.DataType = struct_type(f.get("fields") or []) if kind in ("RECORD", "STRUCT") else _SPARK[scalar(kind)]
    return T.ArrayType(t) if (f.get("mode") or "").upper() == "REPEATED" else t


def struct_type(fields: list[dict]) -> T.StructType:
    return T.StructType([T.StructField(f["name"], field_type(f), True) for f in fields])


def kind_of(t: T.DataType, numeric_as_float: bool = False) -> str:
    match t:
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType() | T.NullType():
            return "INTEGER"
        case T.FloatType() | T.DoubleType():
            return "FLOAT"
        case T.DecimalType():
            if t.scale == 0 and t.precision > 18 and not numeric_as_float:
                return "INTEGER" if t.precision == 20 else "NUMERIC"
            return "FLOAT" if numeric_as_float else "NUMERIC" if t.scale <= 9 else "BIGNUMERIC"
        case T.StringType() | T.CharType() | T.VarcharType():
            return "STRING"
        case T.BinaryType():
            return "BYTES"
        case T.BooleanType():
            return "BOOLEAN"
        case T.DateType():
            return "DATE"
        case T.TimestampType():
            return "TIMESTAMP"
        case T.TimestampNTZType():
            return "DATETIME"
        case T.TimeType():
            return "TIME"
        case T.VariantType():
            return "JSON"
        case T.StructType() | T.MapType():
            return "RECORD"
        case T.DayTimeIntervalType() | T.YearMonthIntervalType():
            return "INTERVAL"
    raise Invalid(f"No GoogleSQL type for {t.simpleString()}")


def rest_field(name: str, t: T.DataType, mode: str = "NULLABLE", numeric_as_float: bool = False) -> dict:
    if isinstance(t, T.ArrayType):
        return rest_field(name, t.elementType, "REPEATED", numeric_as_float)
    if isinstance(t, T.MapType):
        t, mode = T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)]), "REPEATED"
    out: dict = {"name": name, "type": kind_of(t, numeric_as_float), "mode": mode}
    if isinstance(t, T.StructType):
        out["fields"] = [rest_field(f.name, f.dataType, numeric_as_float=numeric_as_float) for f in t.fields]
    return out


def rest_schema(schema: T.StructType, numeric_as_float: bool = False) -> dict:
    return {"fields": [rest_field(f.name, f.dataType, numeric_as_float=numeric_as_float) for f in schema.fields]}


_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def micros(v: dt.datetime) -> int:
    """Microseconds since the epoch; naive values are UTC."""
    v = v.replace(tzinfo=dt.timezone.utc) if v.tzinfo is None else v
    return (v - _EPOCH) // dt.timedelta(microseconds=1)


def rest_value(v, t: T.DataType):
    """The ``v`` of a cell."""
    if v is None:
        return None
    match t:
        case T.ArrayType():
            return [{"v": rest_value(x, t.elementType)} for x in v]
        case T.MapType():
            return [{"v": {"f": [{"v": rest_value(k, t.keyType)}, {"v": rest_value(x, t.valueType)}]}} for k, x in v.items()]
        case T.StructType():
            return {"f": [{"v": rest_value(x, f.dataType)} for x, f in zip(v, t.fields)]}
        case T.BooleanType():
            return "true" if v else "false"
        case T.BinaryType():
            return base64.b64encode(bytes(v)).decode()
        case T.TimestampType():
            return str(micros(v))
        case T.TimestampNTZType() | T.DateType() | T.TimeType():
            return v.isoformat()
        case T.DoubleType() | T.FloatType():
            return str(v) if math.isfinite(v) else "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
        case T.DecimalType():
            s = format(v, "f")
            return s.rstrip("0").rstrip(".") if "." in s else s
        case T.VariantType():
            return v.toJson()
    return str(v)


def rest_rows(rows: list, schema: T.StructType) -> list[dict]:
    return [{"f": [{"v": rest_value(v, f.dataType)} for v, f in zip(r, schema.fields)]} for r in rows]


def python_value(v, t: T.DataType):
    """A collected value as plain Python: JSON parsed, rows as dicts."""
    if v is None:
        return None
    if isinstance(t, T.VariantType):
        return json.loads(v.toJson())
    if isinstance(t, T.StructType):
        return {f.name: python_value(x, f.dataType) for x, f in zip(v, t.fields)}
    if isinstance(t, T.ArrayType):
        return [python_value(x, t.elementType) for x in v]
    if isinstance(t, T.TimestampType):
        return v.replace(tzinfo=dt.timezone.utc) if v.tzinfo is None else v
    if isinstance(t, T.BinaryType):
        return bytes(v)
    return v


def to_spark(v, t: T.DataType):
    """A JSON value (or Python value) as a value that ``createDataFrame`` takes for type ``t``; absent fields are null."""
    if v is None:
        return [] if isinstance(t, T.ArrayType) else None
    match t:
        case T.ArrayType():
            return [to_spark(x, t.elementType) for x in v]
        case T.StructType():
            return tuple(to_spark(v.get(f.name), f.dataType) for f in t.fields)
        case T.LongType():
            return int(v)
        case T.DoubleType():
            return float(v)
        case T.DecimalType():
            return decimal.Decimal(str(v)).quantize(decimal.Decimal(1).scaleb(-t.scale), context=decimal.Context(prec=60))
        case T.BooleanType():
            return v.lower() == "true" if isinstance(v, str) else bool(v)
        case T.BinaryType():
            return bytearray(base64.b64decode(v) if isinstance(v, str) else v)
        case T.DateType():
            return dt.date.fromisoformat(v) if isinstance(v, str) else v
        case T.TimeType():
            return dt.time.fromisoformat(v) if isinstance(v, str) else v
        case T.TimestampType():
            if isinstance(v, (int, float)) or isinstance(v, str) and v.replace(".", "", 1).lstrip("-").isdigit():
                return _EPOCH + dt.timedelta(microseconds=round(decimal.Decimal(str(v)) * 1_000_000))
            d = dt.datetime.fromisoformat(v.replace(" UTC", "+00:00")) if isinstance(v, str) else v
            return d.replace(tzinfo=dt.timezone.utc) if d.tzinfo is None else d
        case T.TimestampNTZType():
            return dt.datetime.fromisoformat(v) if isinstance(v, str) else v
        case T.VariantType():
            return v if isinstance(v, str) else json.dumps(v)
    return v if isinstance(v, str) else json.dumps(v)


def fill_missing(value):
    """Dicts that are neighbours in a list get the union of their keys, absent ones as None; recursive."""
    if isinstance(value, dict):
        return {k: fill_missing(v) for k, v in value.items()}
    if not isinstance(value, list):
        return value
    if value and all(isinstance(x, dict) for x in value):
        keys = list(dict.fromkeys(k for x in value for k in x))
        return [{k: fill_missing(x.get(k)) for k in keys} for x in value]
    return [fill_missing(x) for x in value]
