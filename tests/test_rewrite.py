"""Golden texts of the rewriter, lexing, name encoding, and the semantic traps of functions."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.errors import InvalidQuery
from sparkloom.functions.formats import java_pattern
from sparkloom.functions.params import string
from sparkloom.functions.table import unquote
from sparkloom.functions.types import fill_missing, rest_rows, rest_schema
from sparkloom.plans.lexer import parse, tokens
from sparkloom.plans.rewrite import rewrite, rewrite_expr, type_ddl
from sparkloom.sources.names import Scope, database, decode, encode, undatabase

GOLDEN = {
    "[1,2][OFFSET(0)]": "array(1L, 2L)[0L]",
    "a[SAFE_ORDINAL(2)]": "get(a, CAST(2L AS INT) - 1)",
    "x NOT IN UNNEST([1])": "NOT array_contains(array(1L), x)",
    "a + 1 IN UNNEST(b) AND c": "array_contains(b, a + 1L) AND c",
    "b'ab'": "X'6162'",
    "r'\\d'": "'\\\\d'",
    '"""a"b"""': "'a\"b'",
    "DATE_ADD(d, INTERVAL 2 MONTH)": "add_months(d, CAST(2L AS INT))",
    "COUNTIF(x)": "count_if(x)",
    "CAST(x AS ARRAY<STRUCT<a INT64, b ARRAY<STRING>>>)": "CAST(x AS ARRAY<STRUCT<`a`: BIGINT, `b`: ARRAY<STRING>>>)",
    "SUM(x) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)": "SUM(x) OVER (PARTITION BY a ORDER BY b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "SAFE.PARSE_JSON(s)": "try_parse_json(s)",
    "JSON '{}'": "parse_json('{}')",
    "SPLIT(s, '.')": "split(s, '\\\\.', -1)",
}


@pytest.mark.parametrize("sql", GOLDEN)
def test_golden_expressions(sql):
    assert rewrite_expr(sql) == GOLDEN[sql]


def test_golden_queries():
    assert rewrite("SELECT x FROM UNNEST([1]) AS x WITH OFFSET") == "SELECT x FROM posexplode(array(1L)) AS __u1(`offset`, `x`)"
    assert rewrite("SELECT a FROM d.t QUALIFY RANK() OVER (ORDER BY a) = 1 LIMIT 2") == "SELECT * EXCEPT (__q1) FROM (SELECT a, (CAST(RANK() OVER (ORDER BY a) AS BIGINT) = 1L) AS __q1 FROM `p_local__d`.`t` AS `t`) WHERE __q1 LIMIT 2"
    assert rewrite("SELECT * FROM a, b.c WHERE a.x IS NOT DISTINCT FROM c.x # end") == "SELECT * FROM `p_local__local`.`a` AS `a`, `p_local__b`.`c` AS `c` WHERE a.x IS NOT DISTINCT FROM c.x"


def test_types():
    assert type_ddl(parse("NUMERIC")) == "DECIMAL(38,9)" and type_ddl(parse("NUMERIC(10, 2)")) == "DECIMAL(10, 2)" and type_ddl(parse("JSON")) == "VARIANT" and type_ddl(parse("STRUCT<INT64, x BOOL>")) == "STRUCT<`_field_1`: BIGINT, `x`: BOOLEAN>"
    with pytest.raises(InvalidQuery):
        type_ddl(parse("GEOGRAPHY"))


@pytest.mark.parametrize("bad", ["(", "]", "'a", "`a", "a)", "(]", "'\\q'"])
def test_lexer_errors(bad):
    with pytest.raises(InvalidQuery):
        parse(bad)


def test_strings():
    got = [t.value for t in tokens(r"""'a\n\x41é\'' "d\"q" r'\n' '''x'y''' B'\xff' rb"\x" """)]
    assert got == ["a\nAé'", 'd"q', "\\n", "x'y", b"\xff", b"\\x"]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_names_round_trip(name):
    assert decode(encode(name)) == name and all(c in "abcdefghijklmnopqrstuvwxyz0123456789_" for c in encode(name))


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, alphabet="aZ_x-9é."), st.text(min_size=1, alphabet="aZ_x-9é."))
def test_databases_round_trip(project, dataset):
    assert undatabase(database(project, dataset)) == (project, dataset)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"])))
def test_string_literals_round_trip(text):
    assert unquote(string(text)) == text


def test_scope():
    s = Scope("p-1", "d")
    assert s.table(["t"]) == "`p_p_x2d_1__d`.`t`" and s.resolve(["a", "b", "c", "d"]) == ("a.b", "c", "d")


def test_formats():
    assert java_pattern("%Y-%m-%d at %H:%M:%E3S") == "yyyy-MM-dd' at 'HH:mm:ss.SSS" and java_pattern("%F %T") == "yyyy-MM-dd HH:mm:ss"


def test_fill_missing():
    assert fill_missing({"id": 1, "nested": [{"item": "a"}, {"x": [{"p": 1}, {"q": 2}]}, {}]}) == {"id": 1, "nested": [{"item": "a", "x": None}, {"item": None, "x": [{"p": 1, "q": None}, {"p": None, "q": 2}]}, {"item": None, "x": None}]}


# --------------------------------------------------------------- with Spark
LITERALS = """SELECT NULL AS n, 1 AS i, 1.5 AS f, 'a' AS s, B'abc' AS b, TRUE AS t, DATE '2024-01-01' AS d, TIME '12:34:56' AS tm, DATETIME '2024-01-01 12:34:56' AS dtm, TIMESTAMP '2024-01-01 12:34:56+00' AS ts,
JSON '{"key":"value"}' AS j, [1, 2] AS ai, ['x'] AS sa, STRUCT(1 AS id, 'l' AS label, [STRUCT('item1' AS name)] AS items) AS st, NUMERIC '1.50' AS nu"""


def test_schema_and_cells(engine):
    df = engine.sql(LITERALS)
    fields = {f["name"]: f for f in rest_schema(df.schema)["fields"]}
    kinds = {n: (f["type"], f["mode"]) for n, f in fields.items()}
    scalar = {"n": "INTEGER", "i": "INTEGER", "f": "FLOAT", "s": "STRING", "b": "BYTES", "t": "BOOLEAN", "d": "DATE", "tm": "TIME", "dtm": "DATETIME", "ts": "TIMESTAMP", "j": "JSON", "st": "RECORD", "nu": "NUMERIC"}
    assert kinds == {n: (t, "NULLABLE") for n, t in scalar.items()} | {"ai": ("INTEGER", "REPEATED"), "sa": ("STRING", "REPEATED")}
    assert [(f["name"], f["type"], f["mode"]) for f in fields["st"]["fields"]] == [("id", "INTEGER", "NULLABLE"), ("label", "STRING", "NULLABLE"), ("items", "RECORD", "REPEATED")]
    (row,) = rest_rows(df.collect(), df.schema)
    cells = dict(zip(fields, (c["v"] for c in row["f"])))
    assert cells == {
        "n": None, "i": "1", "f": "1.5", "s": "a", "b": "YWJj", "t": "true", "d": "2024-01-01", "tm": "12:34:56", "dtm": "2024-01-01T12:34:56", "ts": "1704112496000000", "j": '{"key":"value"}', "ai": [{"v": "1"}, {"v": "2"}], "sa": [{"v": "x"}],
        "st": {"f": [{"v": "1"}, {"v": "l"}, {"v": [{"v": {"f": [{"v": "item1"}]}}]}]}, "nu": "1.5",
    }


TRAPS = {
    "SPLIT('a.b', '.')": ["a", "b"],
    "REGEXP_EXTRACT('abc', '[0-9]+')": None,
    "REGEXP_EXTRACT('a12b', '([0-9])([0-9])')": "1",
    "REGEXP_REPLACE('ab', '(a)(b)', r'\\2\\1$')": "ba$",
    "DATE_DIFF(DATE '2024-03-01', DATE '2024-02-29', MONTH)": 1,
    "DATE_DIFF(DATE '2024-01-07', DATE '2024-01-06', WEEK)": 1,
    "DATE_DIFF(DATE '2024-01-08', DATE '2024-01-07', WEEK(MONDAY))": 1,
    "DATETIME_DIFF(DATETIME '2024-01-01 01:00:01', DATETIME '2024-01-01 00:59:59', HOUR)": 1,
    "TIMESTAMP_DIFF(TIMESTAMP '2024-01-01 01:00:01', TIMESTAMP '2024-01-01 00:59:59', HOUR)": 0,
    "[1,2,3][OFFSET(0)] + [1,2,3][ORDINAL(3)]": 4,
    "[1,2][SAFE_OFFSET(5)]": None,
    "7 / 2": 3.5,
    "SAFE_DIVIDE(1, 0)": None,
    "CEIL(1.2)": 2.0,
    "FORMAT_DATE('%d/%m/%y', DATE '2024-05-17')": "17/05/24",
    "PARSE_TIMESTAMP('%Y-%m-%d %H:%M:%S', '2024-05-17 01:02:03')": dt.datetime(2024, 5, 17, 1, 2, 3, tzinfo=dt.timezone.utc),
    "ARRAY_LENGTH((SELECT ARRAY_AGG(x) FROM UNNEST([1, NULL]) AS x))": 2,
    "(SELECT ARRAY_AGG(x IGNORE NULLS) FROM UNNEST([1, NULL]) AS x)": [1],
    "DATE_TRUNC(DATE '2024-05-17', WEEK)": dt.date(2024, 5, 12),
    "DATE_TRUNC(DATE '2024-05-17', ISOYEAR)": dt.date(2024, 1, 1),
    "EXTRACT(WEEK FROM DATE '2024-01-06')": 0,
    "EXTRACT(DAYOFWEEK FROM DATE '2024-05-17')": 6,
    "LAST_DAY(DATE '2024-05-17', YEAR)": dt.date(2024, 12, 31),
    "SAFE_CAST('x' AS INT64)": None,
    "SUBSTR('hello', 0, 2)": "he",
    "SUBSTR('hello', -2)": "lo",
    "TRIM('\\t a \\n')": "a",
    "TO_JSON_STRING([1, NULL])": "[1,null]",
    "JSON_VALUE('{\"a\": {\"b\": 1}}', '$.a')": None,
    "JSON_QUERY('{\"a\": {\"b\": 1}}', '$.a')": '{"b":1}',
    "CONCAT('a', NULL)": None,
    "(1, 2) = (1, 2)": True,
    "'a' IN ('a', 'b') AND 3 BETWEEN 1 AND 5": True,
    "CASE WHEN FALSE THEN 1 ELSE CASE WHEN TRUE THEN 2 END END": 2,
    "TIME_TRUNC(TIME '12:34:56', HOUR)": dt.time(12, 0),
    "GENERATE_ARRAY(5, 1)": [],
    "FORMAT('%5.1f|%t|%%', 2.25, DATE '2024-01-01')": "  2.3|2024-01-01|%",
    "ARRAY<STRING>[]": [],
    "SAFE.SUBSTR('foo', 0, 2)": "fo",
    "IFNULL(NULL, 1) + COALESCE(NULL, 2)": 3,
}


@pytest.mark.parametrize("sql", TRAPS)
def test_traps(engine, sql):
    (row,) = engine.query(f"SELECT {sql} AS v").dicts()
    assert row["v"] == TRAPS[sql]


def test_star_replace_keeps_places(engine):
    assert engine.sql("SELECT * REPLACE (b + 1 AS b) FROM (SELECT 1 AS a, 2 AS b, 3 AS c)").columns == ["a", "b", "c"]
    with pytest.raises(InvalidQuery):
        engine.query("SELECT * REPLACE (1 AS z) FROM (SELECT 1 AS a)")


def test_filters_and_columns_reach_the_scan(spark, engine):
    engine.register("lineitem", spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"))
    plan = engine.sql("SELECT l_orderkey FROM lineitem WHERE l_quantity > @q", {"q": 40.0})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
