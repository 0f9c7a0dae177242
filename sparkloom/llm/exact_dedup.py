"""Exact duplicates against immutable snapshots and inside new batches.

A snapshot is built once, from documents that no longer change: a table of its digests
and a static binary-fuse filter over them, both split by a digest prefix into shards
whose number grows with the snapshot, so no filter has to be broadcast and none
outgrows a task.  Any number of later batches is screened against it without reading
or hashing its documents again.  Digests that a filter admits are joined with the
snapshot's exact digest buckets; rows of the batch are grouped by digest on their own.
Only the texts of rows found by either way are then fetched and compared byte for byte.

Inside one table rows belong to generations: all but the last are snapshots, the last is
the incoming batch, and each is screened against those before it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fuse
from .common import Sealed, col, drop_path, shared_dir, small_side, table, written

#: Generations of op4 and of the pipeline: three snapshots and the incoming batch.
GENERATIONS = 4
#: Digests of a snapshot that a shard has on average.
SHARD_ROWS = 100_000


def generation_of(df: DataFrame, id_col: str, generations: int = GENERATIONS) -> Column:
    """The generation that holds a record, by its id; a null id is in the incoming batch."""
    key = col(id_col)
    number = key if isinstance(df.schema[id_col].dataType, T.IntegralType) else F.xxhash64(key)
    return F.when(key.isNull(), generations - 1).otherwise(F.pmod(number, F.lit(generations)).cast("int"))


def _digest(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def _key(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("key", 8), F.lit(shards)).cast("int")


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "filter": [fuse.build(pdf["key"].to_numpy())]})


def _screen(rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """Digests of rows that the shard's filter admits; there is one filter at most."""
    hit = fuse.contains(filters["filter"].iloc[0], rows["key"].to_numpy()) if len(filters) else np.zeros(len(rows), bool)
    return rows.loc[hit, ["digest"]]


class Snapshot(NamedTuple):
    """Where a snapshot's digests and filters are, and the documents it was built from."""

    path: str
    docs: DataFrame
    id_col: str = "doc_id"
    text_col: str = "text"


def _store(digests: DataFrame, path: str) -> int:
    """Writes a snapshot of ``digests`` (digest, n) below ``path``; returns its number of shards."""
    shards = max(1, -(-digests.count() // SHARD_ROWS))
    rows = written(digests.withColumn("key", _key(F.col("digest"))).withColumn("shard", _shard(shards)), f"{path}/digests")
    written(rows.groupBy("shard").applyInPandas(_build, "shard int, filter binary"), f"{path}/filters")
    written(digests.sparkSession.range(1).select(F.lit(shards).alias("shards")), f"{path}/shards")
    return shards


def build_snapshot(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """The snapshot of ``docs``, written once below ``path``, a folder that must not exist yet.

    Null texts are left out; repeated texts count once.  Extra columns are not read.  No
    rows make a snapshot that admits nothing.
    """
    text = docs.select(col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    digests = written(text.groupBy(_digest(F.col("text")).alias("digest")).agg(F.count("*").alias("n")), f"{path}/counted")
    _store(digests, path)
    drop_path(docs.sparkSession, f"{path}/counted")
    return Snapshot(path, docs, id_col, text_col)


def screen(digests: DataFrame, path: str, shards: int | None = None) -> DataFrame:
    """Distinct digests of ``digests`` (digest) that the snapshot below ``path`` has: filter first, then its exact buckets."""
    read = digests.sparkSession.read.parquet
    shards = shards or read(f"{path}/shards").first()[0]
    rows = digests.select("digest", _key(F.col("digest")).alias("key")).withColumn("shard", _shard(shards))
    hits = rows.groupBy("shard").cogroup(read(f"{path}/filters").groupBy("shard")).applyInPandas(_screen, "digest string")
    return hits.distinct().join(read(f"{path}/digests").select("digest"), "digest", "left_semi")


def suspects(digests: DataFrame, path: str, generations: int) -> DataFrame:
    """Digests of ``digests`` (digest, gen, n) that more than one row has, by filter and bucket or by grouping."""
    found = digests.groupBy("gen", "digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
    for g in range(generations - 1):
        shards = _store(digests.where(F.col("gen") == g).drop("gen"), f"{path}/snapshot-{g}")
        found = found.unionByName(screen(digests.where(F.col("gen") > g), f"{path}/snapshot-{g}", shards))
    return written(found.distinct(), f"{path}/suspects")


def _least(df: DataFrame, by: list[str], generations: int) -> DataFrame:
    """Of each group its rows ``n`` and its least (gen, id), null ids last, as (keep_gen, keep_id)."""
    gens = range(generations)
    has = [F.count_if(F.col("gen") == g).alias(f"h{g}") for g in gens]
    ids = [F.min(F.when(F.col("gen") == g, F.col("id"))).alias(f"i{g}") for g in gens]
    first = lambda of: F.coalesce(*[F.when(F.col(f"h{g}") > 0, of(g)) for g in gens])
    case = F.when(F.lit(False), F.col("i0"))
    for g in gens:
        case = case.when(F.col(f"h{g}") > 0, F.col(f"i{g}"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), *has, *ids).select(*by, "n", first(F.lit).alias("keep_gen"), case.alias("keep_id"))


def _kept_rows(rows: DataFrame, generations: int, path: str) -> DataFrame:
    """``rows`` (id, gen, digest, text) of texts that several have, as (id, gen, digest, keep_id, keep_gen).

    Texts are compared as grouping keys; what goes back to the rows is narrow, one row
    a text, and no group's rows are ever gathered in one place.  Digests that differing
    texts share are joined again by the texts themselves.
    """
    texts = _least(rows, ["digest", "text"], generations)
    of = texts.groupBy("digest").agg(F.count("*").alias("texts"), *[F.first(c).alias(c) for c in ("n", "keep_id", "keep_gen")])
    of = written(of.where("n > 1 OR texts > 1"), f"{path}/texts")
    one, many = of.where("texts = 1"), of.where("texts > 1")
    out = rows.drop("text").join(small_side(one.select("digest", "keep_id", "keep_gen"), one.count()), "digest")
    if n := many.count():
        again = rows.join(small_side(many.select("digest"), n), "digest", "left_semi")
        out = out.unionByName(again.join(_least(again, ["digest", "text"], generations).where("n > 1").drop("n"), ["digest", "text"]).select(*out.columns))
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generations: int = GENERATIONS) -> DataFrame:
    """``(id, digest, gen, n, keep_id, keep_gen)`` for each id of a text that more than one row has.

    ``n`` rows share id and text.  The kept row of a text is the one of the least
    (generation, id), null ids last.  Null texts are not compared; empty texts are
    equal to each other; texts of any length are compared whole.
    """
    path = shared_dir(docs.sparkSession)
    src = docs.select(col(id_col).alias("id"), generation_of(docs, id_col, generations).alias("gen"), col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    src = src.withColumn("digest", _digest(F.col("text")))
    digests = written(src.groupBy("digest", "gen").agg(F.count("*").alias("n")), f"{path}/digests")
    found = suspects(digests, path, generations)
    rows = src.join(small_side(found, found.count()), "digest", "left_semi")
    out = _kept_rows(rows, generations, path)
    groups = written(out.groupBy("id", "digest", "gen", "keep_id", "keep_gen").agg(F.count("*").alias("n")), f"{path}/groups")
    for t in ("digests", "suspects", "texts", *[f"snapshot-{g}" for g in range(generations - 1)]):  # not read again
        drop_path(docs.sparkSession, f"{path}/{t}")
    return groups


def batch_copies(batch: DataFrame, snapshots: list[Snapshot], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, duplicate_of, found_in)`` for each row of ``batch`` whose text is in a snapshot or in a row before it.

    Snapshots come in their order, the first that has a text counts.  Their filters and
    digests are read as build_snapshot wrote them; their documents are read only where
    some digest was found.  ``found_in`` and which row of the batch is kept: see exact_copies.
    """
    path = shared_dir(batch.sparkSession)
    last = len(snapshots)
    part = lambda df, i, t, g: df.select(col(i).alias("id"), F.lit(g).alias("gen"), col(t).cast("string").alias("text")).where("text IS NOT NULL").withColumn("digest", _digest(F.col("text")))
    new = part(batch, id_col, text_col, last)
    digests = written(new.groupBy("digest").agg(F.count("*").alias("n")), f"{path}/digests")
    found = [written(screen(digests, s.path), f"{path}/found-{g}") for g, s in enumerate(snapshots)]
    own = written(digests.where("n > 1").select("digest").unionByName(_union(found, digests)).distinct(), f"{path}/suspects")
    rows = new.join(small_side(own, own.count()), "digest", "left_semi")
    for g, (s, f) in enumerate(zip(snapshots, found)):
        if n := f.count():
            rows = rows.unionByName(part(s.docs, s.id_col, s.text_col, g).join(small_side(f, n), "digest", "left_semi").select(*rows.columns))
    kept = _kept_rows(rows, last + 1, path)
    groups = kept.where(F.col("gen") == last).groupBy("id", "digest", "gen", "keep_id", "keep_gen").agg(F.count("*").alias("n"))
    return _surplus(written(groups, f"{path}/groups"))


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = like.select("digest").where("false")
    for p in parts:
        out = out.unionByName(p)
    return out


_KEPT = "id <=> keep_id AND gen = keep_gen"
#: Rows that one generator makes at most.
_STEP = 10_000


def _surplus(groups: DataFrame) -> DataFrame:
    """One row for each row of ``groups`` but the kept ones."""
    surplus = groups.withColumn("n", F.expr(f"n - IF({_KEPT}, 1, 0)")).where("n > 0")
    surplus = surplus.withColumn("hi", F.explode(F.expr(f"sequence(0, (n - 1) div {_STEP})"))).withColumn("lo", F.explode(F.expr(f"sequence(1, least({_STEP}, n - hi * {_STEP}))")))
    return surplus.select(F.col("id").alias("doc_id"), F.col("keep_id").alias("duplicate_of"), F.expr("IF(keep_gen < gen, 'snapshot', 'batch')").alias("found_in"))


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generations: int = GENERATIONS) -> DataFrame:
    """``(doc_id, duplicate_of, found_in)``: one row for each row of ``docs`` that repeats a kept row.

    ``found_in`` is ``snapshot`` if the kept row is of an older generation, else
    ``batch``.  Rows that repeat a kept row's id and text are surplus rows of it, with
    the same id in both columns.  Ties, nulls and empty texts: see exact_groups.
    Extra columns are not read.  No rows give no rows.
    """
    return _surplus(exact_groups(docs, id_col, text_col, generations))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text; columns unchanged, whatever their names.  Rows with a null text all stay."""
    path = shared_dir(docs.sparkSession)
    sealed = Sealed(docs)
    g = exact_groups(docs, id_col, text_col)
    decided = written(g.select("id", "digest", F.expr(_KEPT).alias("kept"), "n"), f"{path}/decided")
    same = F.col("id").eqNullSafe(sealed.col(id_col)) & (F.col("digest") == _digest(sealed.col(text_col).cast("string")))
    joined = sealed.df.join(small_side(decided, decided.count()), same, "left").where("kept IS NULL OR kept")
    out = joined
    if not decided.where("kept AND n > 1").isEmpty():  # rows that repeat id and text: one of them stays
        again = F.coalesce(F.col("n"), F.lit(1)) > 1
        out = joined.where(~again).unionByName(joined.where(again).dropDuplicates(["id", "digest"]))
    return sealed.open(out)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` that repeats another one's text."""
    return exact_copies(table(spark, sf_dir, "documents"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {
    "op4_exact_dedup": f"""
    WITH d AS (
        SELECT doc_id, text, coalesce(((doc_id % {GENERATIONS}) + {GENERATIONS}) % {GENERATIONS}, {GENERATIONS - 1}) AS gen
        FROM documents WHERE text IS NOT NULL),
    w AS (
        SELECT doc_id, gen, row_number() OVER o AS rn, first_value(doc_id) OVER o AS duplicate_of, first_value(gen) OVER o AS first_gen
        FROM d WINDOW o AS (PARTITION BY text ORDER BY gen, doc_id NULLS LAST))
    SELECT doc_id, duplicate_of, CASE WHEN first_gen < gen THEN 'snapshot' ELSE 'batch' END AS found_in
    FROM w WHERE rn > 1
    """
}
