"""Weighted rendezvous hashing of stable record keys over shards.

Each shard scores each key; the key goes to the shard with the best score
``-weight / ln(u)``, ``u`` being a uniform number in (0, 1) hashed from the key
and the shard's name.  The scores of the other shards do not change when a shard
is added, removed or reweighted, so only the keys that the changed shard wins or
loses move, and a key's place depends on nothing but its own value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table, without

#: 52 bits of the digest, so that the integer is exact in a double.
_HEX, _SPAN = 13, 2.0**52

#: name -> weight: production parameters of op1.  Four of the shards have half, two have double capacity.
SHARDS = {f"shard-{i:02d}": (0.5 if i < 4 else 2.0 if i < 6 else 1.0) for i in range(16)}
#: The shard added to measure how many records move.
ADDED = ("shard-16", 1.0)


def score(key: Column, name: str, weight: float) -> Column:
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + name))), 1, _HEX), 16, 10).cast("double")
    return F.lit(-float(weight)) / F.log((h + F.lit(0.5)) / F.lit(_SPAN))


def shard_of(key: Column, shards: dict[str, float]) -> Column:
    """Name of the winning shard; equal scores go to the smaller name.  One projection, no shuffle."""
    live = {n: w for n, w in shards.items() if w > 0}
    if not live:
        raise ValueError("at least one shard needs a positive weight")
    scored = [F.struct((-score(key, n, w)).alias("s"), F.lit(n).alias("n")) for n, w in sorted(live.items())]
    return (F.least(*scored) if len(scored) > 1 else scored[0])["n"]


def assign_shards(df: DataFrame, key: str, shards: dict[str, float], out: str = "shard") -> DataFrame:
    """``df`` with the column ``out``.

    Nulls in the key hash as the text ``\\N``, so all null-key rows share one shard;
    equal keys (repeated rows) share one too.  Texts are never hashed unless they
    are the key, whatever their length.  An input column called ``out`` is replaced.
    An empty table gives an empty table.
    """
    k = F.coalesce(col(key).cast("string"), F.lit("\\N"))
    return without(df, out).withColumn(out, shard_of(k, shards))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard now and after one shard is added."""
    docs = table(spark, sf_dir, "documents")
    now = assign_shards(docs, "doc_id", SHARDS, "shard")
    return assign_shards(now, "doc_id", {**SHARDS, ADDED[0]: ADDED[1]}, "shard_after_growth")


def _sql() -> str:
    def one(n: str, w: float) -> str:
        return f"""{{'s': {float(w)} / ln((CAST(('0x' || substr(md5(k || '|{n}'), 1, {_HEX})) AS BIGINT) + 0.5::DOUBLE) / {_SPAN}), 'n': '{n}'}}"""

    now = ", ".join(one(n, w) for n, w in sorted(SHARDS.items()))
    return f"""
    SELECT * EXCLUDE (k),
           least({now}).n AS shard,
           least({now}, {one(*ADDED)}).n AS shard_after_growth
    FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '\\N') AS k FROM documents)
    """


QUERIES = {"op1_sharding": op1_sharding}
ORACLE = {"op1_sharding": _sql()}
