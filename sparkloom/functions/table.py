"""GoogleSQL functions as Spark SQL: each entry takes the rendered arguments and gives Spark text.

Names that are absent here mean the same in Spark and pass through.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..errors import InvalidQuery
from .formats import java_pattern
from .params import string

Render = Callable[[list[str]], str]


def unquote(sql: str) -> str | None:
    """The value of a rendered string literal, else None."""
    m = re.fullmatch(r"'((?:[^'\\]|\\.)*)'", sql, re.S)
    if not m:
        return None
    codes = {"n": "\n", "r": "\r", "t": "\t"}
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda x: chr(int(x[1][1:], 16)) if x[1][0] == "u" and len(x[1]) == 5 else codes.get(x[1], x[1]), m[1], flags=re.S)


def const(sql: str, what: str) -> str:
    v = unquote(sql)
    if v is None:
        raise InvalidQuery(f"{what} must be a string literal")
    return v


def rename(name: str) -> Render:
    return lambda a: f"{name}({', '.join(a)})"


def quote_regex(s: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|])", r"\\\1", s)


def java_regex(pattern: str) -> str:
    """RE2 as Java regex: named groups lose the P."""
    return pattern.replace("(?P<", "(?<")


def _regex(sql: str) -> str:
    v = unquote(sql)
    return string(java_regex(v)) if v is not None else sql


def _groups(sql: str) -> int:
    v = unquote(sql)
    if v is None:
        return 0
    try:
        return re.compile(v).groups
    except re.error:
        return len(re.findall(r"(?<!\\)\((?!\?)", v))


def regexp_extract(a: list[str]) -> str:
    p, g = _regex(a[1]), min(_groups(a[1]), 1)
    if len(a) > 2:  # position, occurrence
        src = f"substring({a[0]}, {a[2]})"
        nth = a[3] if len(a) > 3 else "1"
        return f"get(regexp_extract_all({src}, {p}, {g}), CAST({nth} AS INT) - 1)"
    return f"CASE WHEN {a[0]} RLIKE {p} THEN regexp_extract({a[0]}, {p}, {g}) END"


def regexp_replace(a: list[str]) -> str:
    v = unquote(a[2])
    if v is not None:
        out = re.sub(r"\\(\d)|\\\\|\$", lambda m: "$" + m[1] if m[1] else "\\$" if m[0] == "$" else "\\\\", v)
        rep = string(out)
    else:
        rep = f"regexp_replace(regexp_replace({a[2]}, '\\\\$', '\\\\\\\\\\\\$'), '\\\\\\\\([0-9])', '\\\\$$1')"
    return f"regexp_replace({a[0]}, {_regex(a[1])}, {rep})"


def split(a: list[str]) -> str:
    sep = a[1] if len(a) > 1 else "','"
    v = unquote(sep)
    if v == "":
        return f"filter(split({a[0]}, ''), x -> x <> '')"
    return f"split({a[0]}, {string(quote_regex(v)) if v is not None else f'''concat('\\\\Q', {sep}, '\\\\E')'''}, -1)"


def substr(a: list[str]) -> str:
    # a position of 0 counts as 1; one far before the start too, which Spark's window would cut
    if re.fullmatch(r"[1-9]\d*L?", a[1]):
        return f"substring({', '.join(a)})"
    pos = f"(CASE WHEN {a[1]} = 0 OR {a[1]} < -length({a[0]}) THEN 1 ELSE {a[1]} END)"
    return f"substring({a[0]}, CAST({pos} AS INT){f', CAST({a[2]} AS INT)' if len(a) > 2 else ''})"


def trim(fn: str) -> Render:
    side = {"trim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[fn]
    # without a character list Spark trims spaces only, GoogleSQL all white space
    edge = {"trim": r"^\\s+|\\s+$", "ltrim": r"^\\s+", "rtrim": r"\\s+$"}[fn]
    return lambda a: f"TRIM({side} {a[1]} FROM {a[0]})" if len(a) > 1 else f"regexp_replace({a[0]}, '{edge}', '')"


def json_path(sql: str) -> str:
    """JSONPath with quoted members as Spark's bracket form; mode prefixes go."""
    v = unquote(sql)
    if v is None:
        return sql
    v = re.sub(r"^(lax|strict)\s+", "", v)
    v = re.sub(r"""\."((?:[^"\\]|\\.)*)\"""", lambda m: "['" + m[1] + "']", v)
    return string(v)


def _text(x: str) -> str:
    """JSON text of a JSON or string value."""
    m = re.fullmatch(r"parse_json\(('(?:[^'\\]|\\.)*')\)", x, re.S)
    return m[1] if m else f"CAST({x} AS STRING)"


def json_scalar(a: list[str]) -> str:
    p = json_path(a[1]) if len(a) > 1 else "'$'"
    text = _text(a[0])
    # only a text that begins like an array or object is parsed again, to tell a string from these
    return f"transform(array(get_json_object({text}, {p})), g -> CASE WHEN left(g, 1) NOT IN ('{{', '[') OR schema_of_variant(try_variant_get(try_parse_json({text}), {p})) = 'STRING' THEN g END)[0]" if len(a) > 1 else f"variant_get(parse_json({_text(a[0])}), '$', 'string')"


def json_query(a: list[str]) -> str:
    p = json_path(a[1]) if len(a) > 1 else "'$'"
    return f"to_json(variant_get(parse_json({_text(a[0])}), {p}))"


#: Levels of nested objects whose keys JSON_KEYS gives where no depth is named.
JSON_KEY_LEVELS = 8


def json_keys(a: list[str]) -> str:
    """Distinct paths of keys, sorted, level by level down to a literal depth; arrays are not entered."""
    levels = int(a[1].rstrip("L")) if len(a) > 1 and re.fullmatch(r"\d+L?", a[1]) else JSON_KEY_LEVELS

    def members(text: str, path: str) -> str:
        """(path, JSON text) of an object's members."""
        at = "concat('$[\"', k, '\"]')"
        return f"transform(coalesce(json_object_keys({text}), array()), k -> struct({path} AS p, to_json(try_variant_get(try_parse_json({text}), {at})) AS t))"

    level = out = members(_text(a[0]), "k")
    for _ in range(levels - 1):
        level = f"flatten(transform({level}, m -> {members('m.t', 'concat(m.p, chr(46), k)')}))"
        out = f"concat({out}, {level})"
    return f"array_sort(array_distinct(transform({out}, m -> m.p)))"


def json_array(scalars: bool) -> Render:
    def go(a: list[str]) -> str:
        p = json_path(a[1]) if len(a) > 1 else "'$'"
        items = f"variant_get(parse_json({_text(a[0])}), {p}, 'array<variant>')"
        return f"transform({items}, x -> CAST(x AS STRING))" if scalars else f"transform({items}, x -> to_json(x))"

    return go


UNITS = {"MICROSECOND", "MILLISECOND", "SECOND", "MINUTE", "HOUR", "DAY", "WEEK", "MONTH", "QUARTER", "YEAR", "ISOWEEK", "ISOYEAR", "DAYOFWEEK", "DAYOFYEAR", "DATE", "TIME", "DATETIME"}
_WEEKDAYS = {"SUNDAY": 0, "MONDAY": 1, "TUESDAY": 2, "WEDNESDAY": 3, "THURSDAY": 4, "FRIDAY": 5, "SATURDAY": 6}


def _week_day(unit: str) -> int | None:
    """First day of the week of WEEK, WEEK(day), ISOWEEK: 0 is Sunday."""
    u = unit.upper().replace(" ", "")
    if u == "WEEK":
        return 0
    if u == "ISOWEEK":
        return 1
    m = re.fullmatch(r"WEEK\((\w+)\)", u)
    return _WEEKDAYS.get(m[1]) if m else None


def week_start(d: str, first: int) -> str:
    return f"date_sub({d}, pmod(dayofweek({d}) - 1 - {first}, 7))"


def date_diff(a: list[str]) -> str:
    """Boundaries of the unit between two dates or datetimes."""
    x, y, unit = f"CAST({a[0]} AS DATE)", f"CAST({a[1]} AS DATE)", a[2].upper()
    first = _week_day(unit)
    if first is not None:
        return f"CAST(datediff({week_start(x, first)}, {week_start(y, first)}) div 7 AS BIGINT)"
    months = f"(year({x}) - year({y})) * 12 + month({x}) - month({y})"
    match unit:
        case "DAY":
            return f"CAST(datediff({x}, {y}) AS BIGINT)"
        case "MONTH":
            return f"CAST({months} AS BIGINT)"
        case "QUARTER":
            return f"CAST((year({x}) - year({y})) * 4 + quarter({x}) - quarter({y}) AS BIGINT)"
        case "YEAR":
            return f"CAST(year({x}) - year({y}) AS BIGINT)"
        case "ISOYEAR":
            return f"CAST(extract(YEAROFWEEK FROM {x}) - extract(YEAROFWEEK FROM {y}) AS BIGINT)"
    raise InvalidQuery(f"DATE_DIFF does not support {unit}")


_MICROS = {"MICROSECOND": 1, "MILLISECOND": 1000, "SECOND": 10**6, "MINUTE": 60 * 10**6, "HOUR": 3600 * 10**6, "DAY": 86400 * 10**6}


def datetime_diff(a: list[str]) -> str:
    unit = a[2].upper()
    if unit in _MICROS and unit != "DAY":
        # boundaries crossed, not elapsed units
        trunc = lambda v: f"CAST(floor(unix_micros(CAST({v} AS TIMESTAMP)) / {_MICROS[unit]}D) AS BIGINT)" if unit != "MICROSECOND" else f"unix_micros(CAST({v} AS TIMESTAMP))"
        return f"({trunc(a[0])} - {trunc(a[1])})"
    return date_diff(a)


def timestamp_diff(a: list[str]) -> str:
    """Whole units elapsed."""
    unit = a[2].upper()
    if unit not in _MICROS:
        raise InvalidQuery(f"TIMESTAMP_DIFF does not support {unit}")
    return f"((unix_micros(CAST({a[0]} AS TIMESTAMP)) - unix_micros(CAST({a[1]} AS TIMESTAMP))) div {_MICROS[unit]})"


def time_diff(a: list[str]) -> str:
    return f"time_diff('{a[2].upper()}', {a[1]}, {a[0]})"


def interval(a: str, negate: bool = False) -> tuple[str, str] | None:
    """(count, unit) of a rendered ``INTERVAL (n) UNIT``."""
    m = re.fullmatch(r"INTERVAL \((.*)\) (\w+)", a, re.S)
    return (f"-({m[1]})" if negate else m[1], m[2].upper()) if m else None


def date_add(negate: bool) -> Render:
    def go(a: list[str]) -> str:
        if not (iv := interval(a[1], negate)):
            return f"date_add({a[0]}, CAST({'-' if negate else ''}({a[1]}) AS INT))"
        n, unit = iv
        match unit:
            case "DAY":
                return f"date_add({a[0]}, CAST({n} AS INT))"
            case "WEEK":
                return f"date_add({a[0]}, CAST(({n}) * 7 AS INT))"
            case "MONTH":
                return f"add_months({a[0]}, CAST({n} AS INT))"
            case "QUARTER":
                return f"add_months({a[0]}, CAST(({n}) * 3 AS INT))"
            case "YEAR":
                return f"add_months({a[0]}, CAST(({n}) * 12 AS INT))"
        return f"timestampadd({unit}, {n}, CAST({a[0]} AS TIMESTAMP_NTZ))"

    return go


def stamp_add(negate: bool, kind: str) -> Render:
    def go(a: list[str]) -> str:
        iv = interval(a[1], negate)
        if not iv:
            raise InvalidQuery("An INTERVAL is required")
        n, unit = iv
        return f"timestampadd({unit}, CAST({n} AS INT), CAST({a[0]} AS {kind}))" if unit not in ("MICROSECOND", "MILLISECOND", "SECOND") else f"timestampadd({unit}, {n}, CAST({a[0]} AS {kind}))"

    return go


def time_add(negate: bool) -> Render:
    """Wraps around midnight."""

    def go(a: list[str]) -> str:
        n, unit = interval(a[1], negate) or ("0", "SECOND")
        return f"CAST(date_format(timestampadd({unit}, {n}, to_timestamp_ntz(concat('2000-01-02 ', CAST({a[0]} AS STRING)))), 'HH:mm:ss.SSSSSS') AS TIME(6))"

    return go


def date_trunc(a: list[str]) -> str:
    unit = a[1].upper()
    first = _week_day(unit)
    d = f"CAST({a[0]} AS DATE)"
    if first is not None:
        return week_start(d, first)
    if unit == "ISOYEAR":
        return f"next_day(date_sub(make_date(extract(YEAROFWEEK FROM {d}), 1, 4), 7), 'MON')"
    return d if unit == "DAY" else f"trunc({d}, '{unit}')"


def stamp_trunc(kind: str) -> Render:
    def go(a: list[str]) -> str:
        unit, x = a[1].upper(), f"CAST({a[0]} AS {kind})"
        if len(a) > 2:
            return f"to_utc_timestamp(date_trunc('{unit}', from_utc_timestamp({x}, {a[2]})), {a[2]})"
        first = _week_day(unit)
        if first is not None:
            return f"CAST({week_start(f'CAST({x} AS DATE)', first)} AS {kind})"
        return f"CAST(date_trunc('{unit}', {x}) AS {kind})"

    return go


def extract(part: str, src: str) -> str:
    """EXTRACT(part FROM src); all parts are INT64 but DATE, TIME and DATETIME."""
    p = part.upper().replace(" ", "")
    first = _week_day(p)
    if p == "ISOWEEK":
        return f"CAST(weekofyear({src}) AS BIGINT)"
    if first is not None:  # weeks begin on that day; days before the year's first one are week 0
        d = f"CAST({src} AS DATE)"
        return f"CAST((dayofyear({d}) + 6 - pmod(dayofweek({d}) - 1 - {first}, 7)) div 7 AS BIGINT)"
    match p:
        case "DATE":
            return f"CAST({src} AS DATE)"
        case "TIME":
            return f"CAST(date_format({src}, 'HH:mm:ss.SSSSSS') AS TIME(6))"
        case "DATETIME":
            return f"CAST({src} AS TIMESTAMP_NTZ)"
        case "ISOYEAR":
            return f"CAST(extract(YEAROFWEEK FROM {src}) AS BIGINT)"
        case "DAYOFWEEK":
            return f"CAST(dayofweek({src}) AS BIGINT)"
        case "DAYOFYEAR":
            return f"CAST(dayofyear({src}) AS BIGINT)"
        case "MILLISECOND":
            return f"CAST(extract(SECOND FROM {src}) * 1000 AS BIGINT) % 1000"
        case "MICROSECOND":
            return f"CAST(extract(SECOND FROM {src}) * 1000000 AS BIGINT) % 1000000"
        case "SECOND":
            return f"CAST(floor(extract(SECOND FROM {src})) AS BIGINT)"
    return f"CAST(extract({p} FROM {src}) AS BIGINT)"


def to_date(a: list[str]) -> str:
    if len(a) == 3:
        return f"make_date({', '.join(a)})"
    return f"CAST(from_utc_timestamp(CAST({a[0]} AS TIMESTAMP), {a[1]}) AS DATE)" if len(a) == 2 else f"CAST({a[0]} AS DATE)"


def to_datetime(a: list[str]) -> str:
    if len(a) == 6:
        return f"make_timestamp_ntz({', '.join(a)})"
    if len(a) == 2 and (a[1].startswith("CAST") or a[1].upper().startswith("TIME")):
        return f"to_timestamp_ntz(concat(CAST({a[0]} AS STRING), ' ', CAST({a[1]} AS STRING)))"
    return f"CAST(from_utc_timestamp(CAST({a[0]} AS TIMESTAMP), {a[1]}) AS TIMESTAMP_NTZ)" if len(a) == 2 else f"CAST({a[0]} AS TIMESTAMP_NTZ)"


def to_timestamp(a: list[str]) -> str:
    return f"to_utc_timestamp(CAST({a[0]} AS TIMESTAMP), {a[1]})" if len(a) == 2 else f"CAST({a[0]} AS TIMESTAMP)"


def to_time(a: list[str]) -> str:
    return f"make_time({', '.join(a)})" if len(a) == 3 else f"CAST(date_format({a[0]}, 'HH:mm:ss.SSSSSS') AS TIME(6))"


def format_date(cast: str | None = None) -> Render:
    def go(a: list[str]) -> str:
        x = a[1] if cast is None else f"to_timestamp_ntz(concat('2000-01-01 ', CAST({a[1]} AS STRING)))"
        if len(a) > 2:
            x = f"from_utc_timestamp({x}, {a[2]})"
        return f"date_format({x}, {string(java_pattern(const(a[0], 'The format')))})"

    return go


def parse(fn: str) -> Render:
    def go(a: list[str]) -> str:
        p = string(java_pattern(const(a[0], "The format")))
        if fn == "time":
            return f"to_time({a[1]}, {p})"
        got = {"date": "to_date", "timestamp": "to_timestamp", "datetime": "to_timestamp_ntz"}[fn] + f"({a[1]}, {p})"
        return f"to_utc_timestamp({got}, {a[2]})" if len(a) > 2 else got

    return go


def date_array(a: list[str]) -> str:
    step = "INTERVAL '1' DAY"
    if len(a) > 2 and (iv := interval(a[2])):
        n, u = iv
        step = f"make_interval(0, {f'{n}' if u == 'MONTH' else f'({n}) * 3' if u == 'QUARTER' else f'({n}) * 12' if u == 'YEAR' else 0}, {n if u == 'WEEK' else 0}, {n if u == 'DAY' else 0})"
    return f"sequence({a[0]}, {a[1]}, {step})"


def timestamp_array(a: list[str]) -> str:
    n, u = interval(a[2]) or ("1", "DAY")
    unit = {"DAY": 3, "HOUR": 4, "MINUTE": 5, "SECOND": 6}.get(u, 3)
    parts = ["0"] * 7
    parts[unit] = n
    return f"sequence({a[0]}, {a[1]}, make_interval({', '.join(parts)}))"


def generate_array(a: list[str]) -> str:
    step = a[2] if len(a) > 2 else "1"
    lo, hi = a[0], a[1]
    return f"(CASE WHEN sign({step}) * (({hi}) - ({lo})) < 0 THEN array() ELSE sequence({lo}, {hi}, {step}) END)"


def trunc_number(a: list[str]) -> str:
    if len(a) > 1:
        scaled = f"({a[0]}) * power(10, {a[1]})"
        return f"((CASE WHEN {a[0]} < 0 THEN ceil({scaled}) ELSE floor({scaled}) END) / power(10, {a[1]}))"
    return f"CAST(CASE WHEN {a[0]} < 0 THEN ceil({a[0]}) ELSE floor({a[0]}) END AS DOUBLE)"


def whole(fn: str) -> Render:
    return lambda a: f"CAST({fn}({a[0]}) AS DOUBLE)"


def concat_nulls(name: str) -> Render:
    return lambda a: f"{name}({', '.join(a)})"


def array_to_string(a: list[str]) -> str:
    items = f"transform({a[0]}, x -> CAST(x AS STRING))"
    return f"array_join({items}, {', '.join(a[1:])})"


def instr(a: list[str]) -> str:
    if len(a) == 2:
        return f"instr({a[0]}, {a[1]})"
    if len(a) == 3:
        return f"locate({a[1]}, {a[0]}, {a[2]})"
    v, sub, pos, nth = a
    last = f"(length({v}) + 1 + {pos})"
    # places to look at, in the order of counting; matches may overlap
    at = f"CASE WHEN {pos} > 0 AND {pos} <= length({v}) THEN sequence(CAST({pos} AS INT), length({v})) WHEN {pos} < 0 AND {last} > 0 THEN sequence(CAST({last} AS INT), 1, -1) ELSE CAST(array() AS ARRAY<INT>) END"
    return f"CAST(coalesce(get(filter({at}, i -> substring({v}, i, length({sub})) = {sub}), CAST({nth} AS INT) - 1), IF({v} IS NULL OR {sub} IS NULL, NULL, 0)) AS BIGINT)"


def format_string(a: list[str]) -> str:
    v = unquote(a[0])
    if v is None:
        return f"format_string({', '.join(a)})"
    args, out = list(a[1:]), []
    k = 0

    def one(m: re.Match) -> str:
        nonlocal k
        if m[0] == "%%":
            return m[0]
        x = args[k] if k < len(args) else "NULL"
        kind = m[2]
        if kind in "tT":
            out.append(f"CAST({x} AS STRING)" if kind == "t" else f"concat('\"', CAST({x} AS STRING), '\"')")
            kind = "s"
        elif kind == "i":
            out.append(x)
            kind = "d"
        elif kind in "eEfFgG":
            out.append(f"CAST({x} AS DOUBLE)")
            kind = kind.lower() if kind == "F" else kind
        elif kind == "s":
            out.append(f"CAST({x} AS STRING)")
        else:
            out.append(x)
        k += 1
        return f"%{m[1].replace(chr(39), ',')}{kind}"

    f = re.sub(r"%([-+ #0',]*\d*(?:\.\d+)?)([a-zA-Z%])", one, v)
    return f"format_string({', '.join([string(f), *out])})"


def to_json_string(a: list[str]) -> str:
    # a struct around the value takes any type; its name is cut off again
    s = f"to_json(named_struct('v', {a[0]}), map('ignoreNullFields', 'false'))"
    return f"substring({s}, 6, length({s}) - 6)"


def approx_quantiles(a: list[str]) -> str:
    n = int(re.sub(r"L$", "", a[1]))
    return f"percentile_approx({a[0]}, array({', '.join(repr(i / n) for i in range(n + 1))}))"


def round_(a: list[str]) -> str:
    return f"round({', '.join(a)})"


def safe(op: str) -> Render:
    return lambda a: f"try_{op}({', '.join(a)})"


def edit(a: list[str]) -> str:
    return f"levenshtein({a[0]}, {a[1]})"


FUNCTIONS: dict[str, Render] = {
    "SAFE_DIVIDE": safe("divide"), "SAFE_ADD": safe("add"), "SAFE_SUBTRACT": safe("subtract"), "SAFE_MULTIPLY": safe("multiply"), "SAFE_NEGATE": lambda a: f"try_subtract(0, {a[0]})",
    "IEEE_DIVIDE": lambda a: f"(CASE WHEN {a[1]} = 0 THEN (CASE WHEN {a[0]} = 0 OR isnan({a[0]}) THEN CAST('NaN' AS DOUBLE) WHEN {a[0]} > 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END) ELSE {a[0]} / {a[1]} END)",
    "DIV": lambda a: f"(({a[0]}) div ({a[1]}))", "CEIL": whole("ceil"), "CEILING": whole("ceil"), "FLOOR": whole("floor"), "TRUNC": trunc_number, "ROUND": round_,
    "LOG": lambda a: f"ln({a[0]})" if len(a) == 1 else f"log({a[1]}, {a[0]})", "POW": rename("power"), "IS_NAN": rename("isnan"), "IS_INF": lambda a: f"(abs({a[0]}) = CAST('Infinity' AS DOUBLE))", "SIGN": lambda a: f"CAST(sign({a[0]}) AS BIGINT)" if re.fullmatch(r"-?\d+L?", a[0]) else f"sign({a[0]})",
    "RAND": lambda a: "rand()", "SHA1": lambda a: f"unhex(sha1({a[0]}))", "SHA256": lambda a: f"unhex(sha2({a[0]}, 256))", "SHA512": lambda a: f"unhex(sha2({a[0]}, 512))", "MD5": lambda a: f"unhex(md5({a[0]}))",
    "FARM_FINGERPRINT": lambda a: f"xxhash64({a[0]})",
    "TO_HEX": lambda a: f"lower(hex({a[0]}))", "FROM_HEX": rename("unhex"), "TO_BASE64": rename("base64"), "FROM_BASE64": rename("unbase64"), "CODE_POINTS_TO_STRING": lambda a: f"array_join(transform({a[0]}, x -> chr(x)), '')", "TO_CODE_POINTS": lambda a: f"transform(filter(split({a[0]}, ''), x -> x <> ''), x -> CAST(ascii(x) AS BIGINT))",
    "SAFE_CONVERT_BYTES_TO_STRING": lambda a: f"CAST({a[0]} AS STRING)", "LENGTH": rename("length"), "CHAR_LENGTH": rename("length"), "CHARACTER_LENGTH": rename("length"), "BYTE_LENGTH": rename("octet_length"), "SUBSTR": substr, "SUBSTRING": substr,
    "TRIM": trim("trim"), "LTRIM": trim("ltrim"), "RTRIM": trim("rtrim"), "SPLIT": split, "STARTS_WITH": rename("startswith"), "ENDS_WITH": rename("endswith"), "CONTAINS_SUBSTR": lambda a: f"contains(lower(CAST({a[0]} AS STRING)), lower({a[1]}))",
    "STRPOS": lambda a: f"instr({a[0]}, {a[1]})", "INSTR": instr, "EDIT_DISTANCE": edit, "UNICODE": rename("ascii"), "NORMALIZE": lambda a: a[0], "INITCAP": rename("initcap"),
    "REGEXP_CONTAINS": lambda a: f"({a[0]} RLIKE {_regex(a[1])})", "REGEXP_EXTRACT": regexp_extract, "REGEXP_SUBSTR": regexp_extract, "REGEXP_EXTRACT_ALL": lambda a: f"regexp_extract_all({a[0]}, {_regex(a[1])}, {min(_groups(a[1]), 1)})", "REGEXP_REPLACE": regexp_replace, "REGEXP_INSTR": lambda a: f"regexp_instr({a[0]}, {_regex(a[1])})",
    "FORMAT": format_string, "GENERATE_UUID": lambda a: "uuid()", "STRING": lambda a: f"CAST({a[0]} AS STRING)",
    "CURRENT_DATE": lambda a: f"CAST(from_utc_timestamp(current_timestamp(), {a[0]}) AS DATE)" if a else "current_date()", "CURRENT_DATETIME": lambda a: f"CAST(from_utc_timestamp(current_timestamp(), {a[0]}) AS TIMESTAMP_NTZ)" if a else "localtimestamp()", "CURRENT_TIMESTAMP": lambda a: "current_timestamp()", "CURRENT_TIME": lambda a: "current_time(6)",
    "DATE": to_date, "DATETIME": to_datetime, "TIMESTAMP": to_timestamp, "TIME": to_time,
    "DATE_ADD": date_add(False), "DATE_SUB": date_add(True), "DATETIME_ADD": stamp_add(False, "TIMESTAMP_NTZ"), "DATETIME_SUB": stamp_add(True, "TIMESTAMP_NTZ"), "TIMESTAMP_ADD": stamp_add(False, "TIMESTAMP"), "TIMESTAMP_SUB": stamp_add(True, "TIMESTAMP"), "TIME_ADD": time_add(False), "TIME_SUB": time_add(True),
    "DATE_DIFF": date_diff, "DATETIME_DIFF": datetime_diff, "TIMESTAMP_DIFF": timestamp_diff, "TIME_DIFF": time_diff, "DATE_TRUNC": date_trunc, "DATETIME_TRUNC": stamp_trunc("TIMESTAMP_NTZ"), "TIMESTAMP_TRUNC": stamp_trunc("TIMESTAMP"), "TIME_TRUNC": lambda a: f"time_trunc('{a[1].upper()}', {a[0]})",
    "FORMAT_DATE": format_date(), "FORMAT_DATETIME": format_date(), "FORMAT_TIMESTAMP": format_date(), "FORMAT_TIME": format_date("time"), "PARSE_DATE": parse("date"), "PARSE_DATETIME": parse("datetime"), "PARSE_TIMESTAMP": parse("timestamp"), "PARSE_TIME": parse("time"),
    "TIMESTAMP_SECONDS": rename("timestamp_seconds"), "TIMESTAMP_MILLIS": rename("timestamp_millis"), "TIMESTAMP_MICROS": rename("timestamp_micros"), "UNIX_DATE": lambda a: f"CAST(unix_date({a[0]}) AS BIGINT)", "DATE_FROM_UNIX_DATE": lambda a: f"date_from_unix_date(CAST({a[0]} AS INT))",
    "UNIX_SECONDS": lambda a: f"unix_seconds(CAST({a[0]} AS TIMESTAMP))", "UNIX_MILLIS": lambda a: f"unix_millis(CAST({a[0]} AS TIMESTAMP))", "UNIX_MICROS": lambda a: f"unix_micros(CAST({a[0]} AS TIMESTAMP))", "LAST_DAY": lambda a: f"last_day({a[0]})",
    "GENERATE_DATE_ARRAY": date_array, "GENERATE_TIMESTAMP_ARRAY": timestamp_array, "GENERATE_ARRAY": generate_array,
    "ARRAY_LENGTH": lambda a: f"CAST(size({a[0]}) AS BIGINT)", "ARRAY_CONCAT": concat_nulls("concat"), "ARRAY_TO_STRING": array_to_string, "ARRAY_REVERSE": rename("reverse"), "ARRAY_FIRST": lambda a: f"{a[0]}[0]", "ARRAY_LAST": lambda a: f"element_at({a[0]}, -1)", "ARRAY_SLICE": lambda a: f"slice({a[0]}, {a[1]} + 1, {a[2]} - {a[1]} + 1)",
    "JSON_VALUE": json_scalar, "JSON_EXTRACT_SCALAR": json_scalar, "JSON_QUERY": json_query, "JSON_EXTRACT": json_query, "JSON_VALUE_ARRAY": json_array(True), "JSON_EXTRACT_STRING_ARRAY": json_array(True), "JSON_QUERY_ARRAY": json_array(False), "JSON_EXTRACT_ARRAY": json_array(False),
    "PARSE_JSON": lambda a: f"parse_json({a[0]})", "TO_JSON_STRING": to_json_string, "TO_JSON": lambda a: f"parse_json({to_json_string(a)})", "JSON_TYPE": lambda a: f"lower(schema_of_variant({a[0]}))", "INT64": lambda a: f"CAST({a[0]} AS BIGINT)", "FLOAT64": lambda a: f"CAST({a[0]} AS DOUBLE)", "BOOL": lambda a: f"CAST({a[0]} AS BOOLEAN)",
    "JSON_KEYS": json_keys, "LAX_INT64": lambda a: f"try_cast({a[0]} AS BIGINT)", "LAX_STRING": lambda a: f"try_cast({a[0]} AS STRING)",
    "COUNTIF": rename("count_if"), "LOGICAL_AND": rename("bool_and"), "LOGICAL_OR": rename("bool_or"), "APPROX_QUANTILES": approx_quantiles, "APPROX_TOP_COUNT": lambda a: f"transform(approx_top_k({a[0]}, {a[1]}), x -> named_struct('value', x.item, 'count', x.count))",
    "HLL_COUNT.INIT": lambda a: f"hll_sketch_agg({a[0]})", "HLL_COUNT.MERGE": lambda a: f"hll_sketch_estimate(hll_union_agg({a[0]}))", "HLL_COUNT.MERGE_PARTIAL": lambda a: f"hll_union_agg({a[0]})", "HLL_COUNT.EXTRACT": lambda a: f"hll_sketch_estimate({a[0]})",
    "ERROR": rename("raise_error"), "SESSION_USER": lambda a: "current_user()", "NULLIFZERO": rename("nullifzero"), "ZEROIFNULL": rename("zeroifnull"), "RANGE_BUCKET": lambda a: f"CAST(size(filter({a[1]}, x -> x <= {a[0]})) AS BIGINT)",
    "JUSTIFY_INTERVAL": lambda a: a[0],
}

#: SAFE.f(...): what gives null where f would fail.
SAFE_FUNCTIONS: dict[str, Render] = {
    "PARSE_JSON": lambda a: f"try_parse_json({a[0]})", "PARSE_DATE": lambda a: f"CAST(try_to_timestamp({a[1]}, {string(java_pattern(const(a[0], 'The format')))}) AS DATE)", "PARSE_TIMESTAMP": lambda a: f"try_to_timestamp({a[1]}, {string(java_pattern(const(a[0], 'The format')))})", "PARSE_DATETIME": lambda a: f"CAST(try_to_timestamp({a[1]}, {string(java_pattern(const(a[0], 'The format')))}) AS TIMESTAMP_NTZ)",
    "LN": lambda a: f"CASE WHEN {a[0]} > 0 THEN ln({a[0]}) END", "LOG": lambda a: f"CASE WHEN {a[0]} > 0 THEN {FUNCTIONS['LOG'](a)} END", "LOG10": lambda a: f"CASE WHEN {a[0]} > 0 THEN log10({a[0]}) END", "SQRT": lambda a: f"CASE WHEN {a[0]} >= 0 THEN sqrt({a[0]}) END",
    "DIV": lambda a: f"CASE WHEN {a[1]} <> 0 THEN {FUNCTIONS['DIV'](a)} END", "MOD": lambda a: f"try_mod({a[0]}, {a[1]})", "SUBSTR": substr, "FROM_BASE64": lambda a: f"try_to_binary({a[0]}, 'base64')", "FROM_HEX": lambda a: f"try_to_binary({a[0]}, 'hex')", "CAST": lambda a: f"try_cast({a[0]})",
}

#: Bare words that are calls without parentheses.
BARE = {"CURRENT_DATE": "current_date()", "CURRENT_TIMESTAMP": "current_timestamp()", "CURRENT_DATETIME": "localtimestamp()", "CURRENT_TIME": "current_time(6)"}
