"""UPDATE, DELETE and MERGE on Parquet tables as projections of the whole table (copy on write)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import ddl
from ..sources.names import quote


def coerce(expr: str, have: T.DataType | None, want: T.DataType) -> str:
    """``expr`` as a value of a column: JSON text is parsed, everything else cast."""
    if have == want:
        return expr
    if isinstance(want, T.VariantType):
        return f"parse_json({expr})" if isinstance(have, T.StringType) else f"CAST({expr} AS VARIANT)"
    return f"CAST({expr} AS {ddl(want)})"


def fitted(df: DataFrame, target: T.StructType, columns: list[str] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """``df``, whose columns stand for ``columns`` by position, as rows of ``target``; absent columns get their default or null."""
    columns = columns or target.fieldNames()
    if len(columns) != len(df.columns):
        from ..errors import InvalidQuery

        raise InvalidQuery(f"Inserted row has wrong column count; has {len(df.columns)}, expected {len(columns)}")
    df = df.toDF(*[f"__c{i}" for i in range(len(columns))])
    at = {c.lower(): i for i, c in enumerate(columns)}
    out = []
    for f in target.fields:
        i = at.get(f.name.lower())
        if i is None:
            d = (defaults or {}).get(f.name)
            e = f"CAST({d} AS {ddl(f.dataType)})" if d else f"CAST(NULL AS {ddl(f.dataType)})"
            if d and isinstance(f.dataType, T.VariantType):
                e = d
        else:
            e = coerce(f"__c{i}", df.schema[i].dataType, f.dataType)
        out.append(F.expr(e).alias(f.name))
    return df.select(out)


@dataclass
class When:
    """A clause of MERGE: ``kind`` is matched, target (not matched by target) or source."""

    kind: str
    condition: str | None
    action: str  # update, delete, insert
    sets: dict[str, str] = field(default_factory=dict)


def update(spark: SparkSession, table: str, alias: str, schema: T.StructType, sets: dict[str, str], where: str, source: str | None) -> tuple[DataFrame, Observation]:
    """(new contents, which count the rows changed as they are written)."""
    if source:  # UPDATE ... FROM is a merge of the joined rows
        return merge(spark, table, alias, schema, source, where, [When("matched", None, "update", sets)])
    hit = f"coalesce(({where}), FALSE)"
    cols = []
    for f in schema.fields:
        old = f"{quote(alias)}.{quote(f.name)}"
        e = sets.get(f.name.lower())
        cols.append(f"CASE WHEN {hit} THEN {_as(spark, e, f, table, alias)} ELSE {old} END AS {quote(f.name)}" if e is not None else f"{old} AS {quote(f.name)}")
    return _counted(spark.sql(f"SELECT {', '.join(cols)}, {hit} AS __hit FROM {table} AS {quote(alias)}"))


def _as(spark: SparkSession, e: str, f: T.StructField, table: str, alias: str, more: str = "") -> str:
    have = spark.sql(f"SELECT {e} AS v FROM {table} AS {quote(alias)}{more}").schema["v"].dataType
    return coerce(e, have, f.dataType)


def _counted(rows: DataFrame, keep: str = "TRUE") -> tuple[DataFrame, Observation]:
    """``rows`` where ``keep`` holds, without the columns added here; the rows with ``__hit`` are counted in the stage that writes."""
    seen = Observation()
    names = [c for c in rows.columns if c not in ("__hit", "__action")]
    return rows.observe(seen, F.count_if("__hit").alias("n")).where(keep).select([quote(c) for c in names]), seen


def delete(spark: SparkSession, table: str, alias: str, where: str) -> tuple[DataFrame, Observation]:
    return _counted(spark.sql(f"SELECT {quote(alias)}.*, coalesce(({where}), FALSE) AS __hit FROM {table} AS {quote(alias)}"), "NOT __hit")


def merge(spark: SparkSession, table: str, alias: str, schema: T.StructType, source: str, on: str, whens: list[When]) -> tuple[DataFrame, Observation]:
    """One join of target and source; the first clause whose condition holds decides a row.

    The join is as wide as the clauses need: without inserts it keeps the target's side
    only, without clauses on unmatched rows of either side it is still left outer, as
    unmatched target rows stay.
    """
    inserts = any(w.kind == "target" for w in whens)
    src_alias = source.rsplit(" AS ", 1)[-1]
    t = f"(SELECT *, TRUE AS __t, monotonically_increasing_id() AS __row FROM {table}) AS {quote(alias)}"
    s = f"(SELECT *, TRUE AS __s FROM {source}) AS {src_alias}"
    join = f"FROM {t} {'FULL' if inserts else 'LEFT'} OUTER JOIN {s} ON {on}"
    more = f" CROSS JOIN {source}"
    state = {"matched": "__t AND __s", "target": "__t IS NULL", "source": "__t AND __s IS NULL"}
    arms = [f"WHEN {state[w.kind]}{f' AND ({w.condition})' if w.condition else ''} THEN {i}" for i, w in enumerate(whens)]
    action = f"CASE {' '.join(arms)} WHEN __t IS NULL THEN -2 ELSE -1 END"
    cols = []
    for f in schema.fields:
        old = f"{quote(alias)}.{quote(f.name)}"
        cases = []
        for i, w in enumerate(whens):
            e = w.sets.get(f.name.lower())
            if w.action == "insert":
                cases.append(f"WHEN {i} THEN {_as(spark, e, f, table, alias, more)}" if e is not None else f"WHEN {i} THEN CAST(NULL AS {ddl(f.dataType)})")
            elif w.action == "update" and e is not None:
                cases.append(f"WHEN {i} THEN {_as(spark, e, f, table, alias, more)}")
        cols.append((f"CASE {action} {' '.join(cases)} ELSE {old} END" if cases else old) + f" AS {quote(f.name)}")
    out = spark.sql(f"SELECT {', '.join(cols)}, {action} AS __action, {quote(alias)}.__row AS __row {join}")
    drop = [i for i, w in enumerate(whens) if w.action == "delete"] + [-2]
    changed = [i for i, w in enumerate(whens) if w.kind == "matched"]
    if changed:  # a target row may be changed by one source row only
        from pyspark.sql import Window

        hits = F.sum(F.when(F.col("__action").isin(changed), 1).otherwise(0)).over(Window.partitionBy("__row"))
        out = out.withColumn("__hits", F.when(F.col("__row").isNull(), 0).otherwise(hits))
        out = out.withColumn("__action", F.when(F.col("__hits") > 1, F.raise_error(F.lit("UPDATE/MERGE must match at most one source row for each target row")).cast("int")).otherwise(F.col("__action")))
        # other join partners of a row, for which no clause holds, are not more rows of the target
        rank = F.row_number().over(Window.partitionBy("__row").orderBy(F.desc("__action")))
        out = out.withColumn("__rank", F.when(F.col("__row").isNull(), 1).otherwise(rank)).where("__rank = 1")
    out = out.select(*[quote(f.name) for f in schema.fields], "__action", (F.col("__action") >= 0).alias("__hit"))
    return _counted(out, f"__action NOT IN ({', '.join(map(str, drop))})")
