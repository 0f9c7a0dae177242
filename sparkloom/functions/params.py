"""Query parameters as typed Spark SQL expressions."""

from __future__ import annotations

import base64
import datetime as dt
import decimal

from ..errors import Invalid
from .types import scalar


def string(s: str) -> str:
    """A Spark string literal."""
    out = s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t").replace("\0", "\\u0000")
    return f"'{out}'"


def ddl(t: dict) -> str:
    """Spark DDL of a REST parameter type."""
    kind = t.get("type", "STRING").upper()
    if kind == "ARRAY":
        return f"ARRAY<{ddl(t['arrayType'])}>"
    if kind in ("STRUCT", "RECORD"):
        return "STRUCT<" + ", ".join(f"`{f.get('name') or f'_field_{i + 1}'}`: {ddl(f['type'])}" for i, f in enumerate(t.get("structTypes") or [])) + ">"
    try:
        return scalar(kind)
    except Invalid:
        return "VOID"


def _scalar(value: str, kind: str) -> str:
    kind = kind.upper()
    spark = scalar(kind)
    match spark:
        case "STRING":
            return string(value)
        case "BIGINT":
            return f"{int(value)}L" if -(2**63) < int(value) else "(-9223372036854775807L - 1L)"
        case "DOUBLE":
            return f"CAST({string(str(value))} AS DOUBLE)"
        case "BOOLEAN":
            return "TRUE" if str(value).lower() == "true" else "FALSE"
        case "BINARY":
            return f"X'{base64.b64decode(value).hex()}'"
        case "VARIANT":
            return f"parse_json({string(value)})"
        case "TIMESTAMP":
            d = dt.datetime.fromisoformat(value.replace(" UTC", "+00:00").replace("Z", "+00:00"))
            d = d if d.tzinfo else d.replace(tzinfo=dt.timezone.utc)
            return f"TIMESTAMP '{d.astimezone(dt.timezone.utc).isoformat(sep=' ')}'"
        case "TIMESTAMP_NTZ":
            return f"TIMESTAMP_NTZ '{dt.datetime.fromisoformat(value).replace(tzinfo=None).isoformat(sep=' ')}'"
    if spark.startswith("DECIMAL"):
        return f"CAST('{decimal.Decimal(value):f}' AS {spark})"
    return f"CAST({string(value)} AS {spark})"


def render(t: dict, v: dict | None) -> str:
    """Spark SQL of a REST parameter value; absent values are typed nulls, an unknown type is NULL."""
    kind = t.get("type", "STRING").upper()
    if ddl(t) == "VOID":
        return "NULL"
    if v is None:
        return f"CAST(NULL AS {ddl(t)})"
    if kind == "ARRAY":
        items = v.get("arrayValues")
        return f"CAST(array({', '.join(render(t['arrayType'], x) for x in items or [])}) AS {ddl(t)})"
    if kind in ("STRUCT", "RECORD"):
        values = v.get("structValues") or {}
        parts = []
        for i, f in enumerate(t.get("structTypes") or []):
            name = f.get("name") or f"_field_{i + 1}"
            parts.append(f"{string(name)}, {render(f['type'], values.get(name))}")
        return f"named_struct({', '.join(parts)})"
    if v.get("value") is None:
        return f"CAST(NULL AS {ddl(t)})"
    return _scalar(v["value"], kind)


def from_rest(parameters: list[dict] | None) -> dict[str, str]:
    """REST query parameters by name, unnamed ones as ``param0``, ``param1``, ..."""
    out = {}
    for i, p in enumerate(parameters or []):
        out[(p.get("name") or f"param{i}").lower()] = render(p["parameterType"], p.get("parameterValue"))
    return out


def from_python(value) -> str:
    """Spark SQL of a Python value: scalars, lists, dicts."""
    match value:
        case None:
            return "NULL"
        case bool():
            return "TRUE" if value else "FALSE"
        case int():
            return f"{value}L"
        case float():
            return f"CAST('{value!r}' AS DOUBLE)"
        case decimal.Decimal():
            return f"CAST('{value:f}' AS DECIMAL(38,9))"
        case str():
            return string(value)
        case bytes() | bytearray():
            return f"X'{bytes(value).hex()}'"
        case dt.datetime():
            return f"TIMESTAMP '{value.astimezone(dt.timezone.utc).isoformat(sep=' ')}'" if value.tzinfo else f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'"
        case dt.date():
            return f"DATE '{value.isoformat()}'"
        case dt.time():
            return f"CAST('{value.isoformat()}' AS TIME(6))"
        case list() | tuple():
            return f"array({', '.join(map(from_python, value))})"
        case dict():
            return f"named_struct({', '.join(f'{string(k)}, {from_python(v)}' for k, v in value.items())})"
    raise Invalid(f"No SQL for a parameter of type {type(value).__name__}")
