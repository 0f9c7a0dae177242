"""JavaScript functions: Arrow batches piped to one node process per Python worker and function."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import json
import shutil
import subprocess
from collections.abc import Callable

import pandas as pd

from ..errors import Unsupported

_LOOP = """
const rl = require('readline').createInterface({input: process.stdin, terminal: false});
const f = new Function(%s, %s);
rl.on('line', (line) => {
  const out = JSON.parse(line).map((row) => {
    try { const v = f(...row); return [0, v === undefined ? null : v]; } catch (e) { return [1, String(e && e.message || e)]; }
  });
  process.stdout.write(JSON.stringify(out) + '\\n');
});
"""

_running: dict[tuple, subprocess.Popen] = {}


def _process(names: tuple[str, ...], body: str) -> subprocess.Popen:
    key = (names, body)
    p = _running.get(key)
    if p is None or p.poll() is not None:
        node = shutil.which("node") or shutil.which("nodejs")
        if not node:
            raise Unsupported("JavaScript functions need node on every executor")
        p = subprocess.Popen([node, "-e", _LOOP % (json.dumps(",".join(names)), json.dumps(body))], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")
        _running[key] = p
    return p


def _plain(v):
    """A column value as JavaScript sees it: INT64 and NUMERIC as numbers, beyond 2**53 as text (a number would lose digits), BYTES as base64."""
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float) and v != v:
        return None
    if isinstance(v, (bytes, bytearray)):
        return base64.b64encode(v).decode()
    if isinstance(v, (dt.date, dt.time, pd.Timestamp)):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, int) and not -(2**53) <= v <= 2**53:
        return str(v)
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return _plain(v.asDict(recursive=True))
    return [_plain(x) for x in v] if isinstance(v, list) else v


def _back(v, kind: str):
    if v is None:
        return None
    if kind == "bigint":
        return int(v)
    if kind == "double":
        return float(v)
    if kind == "string":
        return v if isinstance(v, str) else json.dumps(v) if isinstance(v, (dict, list)) else str(v).lower() if isinstance(v, bool) else str(v)
    if kind == "binary":
        return base64.b64decode(v)
    if kind == "boolean":
        return bool(v)
    if kind == "date":
        return dt.date.fromisoformat(str(v)[:10])
    if kind.startswith("timestamp"):
        return pd.Timestamp(v).tz_localize(None) if pd.Timestamp(v).tzinfo is None else pd.Timestamp(v).tz_convert("UTC").tz_localize(None)
    if kind.startswith("decimal"):
        return decimal.Decimal(str(v))
    return v


def js_function(names: tuple[str, ...], body: str, kind: str) -> Callable[..., pd.Series]:
    """What a pandas UDF calls: one request a batch, errors raised with the script's message."""

    def call(*cols: pd.Series) -> pd.Series:
        p = _process(names, body)
        rows = [[_plain(v) for v in r] for r in zip(*cols)]
        try:
            p.stdin.write(json.dumps(rows) + "\n")
            p.stdin.flush()
            answer = p.stdout.readline()
        except BrokenPipeError:
            answer = ""
        if not answer:
            raise RuntimeError(f"JavaScript function ended with exit code {p.wait()}")
        out = json.loads(answer)
        for bad, v in out:
            if bad:
                raise RuntimeError(f"JavaScript error: {v}")
        values = [_back(v, kind) for _, v in out]
        dtype = {"bigint": "Int64", "double": "Float64", "boolean": "boolean"}.get(kind)
        return pd.Series(pd.array(values, dtype=dtype) if dtype else values, dtype=dtype or object)

    return call


def register(spark, name: str, args: list[tuple[str, str]], returns: str, body: str) -> None:
    """Registers ``name`` (arguments with their Spark DDL types) in the session."""
    from pyspark.sql.types import _parse_datatype_string

    from ..session import ship

    ship(spark)
    kind = _parse_datatype_string(returns)
    names = tuple(a for a, _ in args) or ("_unused",)
    spark.udf.register(name, _udf(js_function(names, body, kind.simpleString()), kind))


def _udf(call: Callable[..., pd.Series], kind):
    from pyspark.sql.functions import pandas_udf

    def apply(*cols: pd.Series) -> pd.Series:
        return call(*cols)

    apply.__annotations__ = {"cols": pd.Series, "return": pd.Series}  # as objects: this module's annotations are texts
    return pandas_udf(apply, kind)
