"""MinHash near-duplicate groups.

1. *Signatures*: each text becomes the set of its word shingles; ``K`` universal
   hashes ``(a*x + b) mod 2**64`` (32-bit ``x``, top bits kept: multiply-shift) give
   ``K`` minima.  Documents whose whole signatures agree collapse to one
   representative, so copies cost one row each from here on.
2. *Banding*: ``BANDS`` keys of ``ROWS`` minima.  Only narrow rows (key, id) are shuffled.
3. *Verification*: in each bucket the signatures (one byte a minimum) are compared;
   a breadth-first search compares each document with those not reached yet, which
   finds the same connected documents as comparing all pairs, without a cap.  A bucket
   of more than ``BLOCK`` documents is never in one place: all of it is compared with
   one of its documents, and what that leaves unreached with the rest, block by block.
4. *Components*: alternating large-star and small-star over the verified edges, each
   round written to the shared folder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, col, drop_path, shared_dir, small_batches, small_side, table, written

SHINGLE = 3
BANDS, ROWS = 36, 4
K = BANDS * ROWS
#: Word-shingle Jaccard similarity from which two documents are near copies, and the estimate at which a pair is accepted: lower by about one standard error of the estimate, so that few true pairs are lost to it.
SIMILARITY, ACCEPT = 0.55, 0.50
SEED = 20240917
#: Bucket members that one Python call verifies on average, and members of a bucket from which it is split.
CELL_MEMBERS, BLOCK = 50_000, 20_000

#: Thai, Lao, Tibetan, Burmese, Khmer, kana and Han: written without spaces, so each character is a word.
_UNSPACED = r"\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORD = re.compile(rf"[^\W{_UNSPACED}]+|[{_UNSPACED}]")
_CACHE_WORDS = 60_000
_CHUNK = 1 << 15
_SLICE = 512


def coefficients(k: int = K, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, k, dtype=np.uint64)


class _Words(dict):
    """word -> 64-bit hash, filled on demand, emptied when it grows too large."""

    def __missing__(self, w: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


_words = _Words()
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of the word shingles (with repeats); a shorter text is one shingle, a text without words none."""
    words = _WORD.findall(text.lower())
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    w = min(size, n)
    out = h[: n - w + 1].copy()
    for j in range(1, w):
        out *= _MIX1
        out ^= out >> np.uint64(29)
        out += h[j : n - w + 1 + j]
    out *= _MIX2
    return out >> np.uint64(32)


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row of ``len(a)`` 32-bit minima for each non-empty set of 32-bit values."""
    out = np.empty((len(sets), len(a)), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (n == 0 or n + len(sets[j]) <= _CHUNK):
            n += len(sets[j])
            j += 1
        if j == i + 1:
            out[i] = _long(sets[i], a, b)
        else:
            x = np.concatenate(sets[i:j])
            starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i : j - 1]])))
            v = np.empty_like(x)
            for k in range(len(a)):
                np.multiply(x, a[k], out=v)
                v += b[k]
                out[i:j, k] = np.minimum.reduceat(v, starts) >> np.uint64(32)
        i = j
    return out


def _long(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    v = np.empty(min(len(x), _CHUNK), np.uint64)
    for s in range(0, len(x), _CHUNK):
        part = x[s : s + _CHUNK]
        w = v[: len(part)]
        for k in range(len(a)):
            np.multiply(part, a[k], out=w)
            w += b[k]
            best[k] = min(best[k], w.min())
    return (best >> np.uint64(32)).astype(np.uint32)


def estimate(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Jaccard similarity estimated from one-byte minima, corrected for chance agreement of bytes."""
    agree = (others == sig).mean(axis=1)
    return (agree - 1 / 256) / (1 - 1 / 256)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = coefficients()
    for batch in batches:
        for start in range(0, len(batch), _SLICE):  # a slice's arrays are all that is held besides the batch
            part = batch.slice(start, _SLICE)
            at, sets = [], []
            for i, text in enumerate(part.column("text")):
                s = shingles(text.as_py())
                if len(s):
                    at.append(i)
                    sets.append(s)
            if not at:
                continue
            m = signatures(sets, a, b)
            bands = m.reshape(len(at), BANDS, ROWS)
            keys = [[xxhash.xxh3_64_intdigest(x.tobytes(), seed=k) - 2**63 for k, x in enumerate(r)] for r in bands]
            made = [pa.array([r.tobytes() for r in m.astype(np.uint8)], pa.binary()), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in m], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            given = part.select(["node", "id", "text_key"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*given.columns, *made], ["node", "id", "text_key", "sig", "whole", "bands"])


def _search(ids: np.ndarray, sigs: np.ndarray, left: np.ndarray, first: np.ndarray, root: int | None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges (member, root) that a breadth-first search over the rows ``left`` finds, begun at the rows ``first`` for the document ``root``.

    Each reached document is compared with all documents not reached yet; a document
    reached before is connected already, so skipping it loses no connection.
    """
    src, dst = [], []
    queue = list(first)
    while len(left):
        if not queue:
            root, queue, left = ids[left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = estimate(sigs[queue.pop()], sigs[left]) >= ACCEPT
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                src.append(ids[found])
                dst.append(np.full(len(found), root, dtype=ids.dtype))
        queue = []
    return src, dst


def _edges(src: list[np.ndarray], dst: list[np.ndarray]) -> pd.DataFrame:
    none = [np.empty(0, np.int64)]
    u, v = np.concatenate(src or none), np.concatenate(dst or none)
    return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)}).query("u != v").drop_duplicates()


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), -1)


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of the buckets of one cell: their verified components as stars."""
    pdf = pdf.sort_values(["b1", "b2", "node"], kind="stable")
    ids, sigs = pdf["node"].to_numpy(), _matrix(pdf)
    code = pdf[["b1", "b2"]].to_numpy()
    starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]).any(axis=1)])
    sizes = np.diff(np.r_[starts, len(ids)])
    pairs = starts[sizes == 2]
    pairs = pairs[estimate(sigs[pairs], sigs[pairs + 1]) >= ACCEPT]
    src, dst = [ids[pairs + 1]], [ids[pairs]]
    for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
        u, v = _search(ids, sigs, np.arange(start, start + size), np.empty(0, int), None)
        src += u
        dst += v
    return _edges(src, dst)


def _near_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            agree = (_matrix(pdf) == np.frombuffer(b"".join(pdf.pop("pivot_sig")), np.uint8).reshape(len(pdf), -1)).mean(axis=1)
            yield pdf.assign(near=(agree - 1 / 256) / (1 - 1 / 256) >= ACCEPT)


def _link_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of two blocks of a large bucket; those near its pivot are connected already and only reach others."""
    ids, sigs, near = pdf["node"].to_numpy(), _matrix(pdf), pdf["near"].to_numpy(bool)
    return _edges(*_search(ids, sigs, np.flatnonzero(~near), np.flatnonzero(near), pdf["pivot"].iloc[0]))


_EDGE = "u long, v long"


def _large(sets: DataFrame, rep: DataFrame, path: str) -> DataFrame | None:
    """Edges of the buckets that are split into chunks, or None if there are none.

    All members are compared with the bucket's least one, its pivot.  Those that it does
    not reach are compared with all others in pairs of blocks, each a task of its own,
    so the same documents are connected as by comparing all pairs of the bucket.
    """
    split = sets.where("chunks > 1")
    if split.isEmpty():
        return None
    pivots = split.groupBy("b1", "b2").agg(F.min(F.element_at("nodes", 1)).alias("pivot"))
    pivots = pivots.join(rep.select(F.col("node").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
    members = split.select("b1", "b2", F.explode("nodes").alias("node")).join(rep.select("node", "sig"), "node")
    members = members.join(pivots, ["b1", "b2"]).select("b1", "b2", "node", "sig", "pivot", "pivot_sig")
    members = written(members.mapInPandas(_near_pivot, "b1 long, b2 long, node long, sig binary, pivot long, near boolean"), f"{path}/large")
    reached = members.where("near AND node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    parts = members.groupBy("b1", "b2").agg(blocks(F.count_if("near")).alias("nn"), blocks(F.count_if(~F.col("near"))).alias("nf")).where("nf > 0")
    rows = members.join(parts, ["b1", "b2"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.when(F.col("near"), F.col("nn")).otherwise(F.col("nf"))).cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    some = [*members.columns, "block"]
    near = rows.where("near").select(*some, each("nf")).select(*members.columns, F.lit(0).alias("kind"), F.col("other").alias("x"), F.col("block").alias("y"))
    far = rows.where("NOT near").select(*some, each("nn")).select(*members.columns, F.lit(0).alias("kind"), F.col("block").alias("x"), F.col("other").alias("y"))
    pair = rows.where("NOT near").select(*some, "nf", each("nf")).where("block <> other").select(*members.columns, F.lit(1).alias("kind"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    linked = near.unionByName(far).unionByName(pair).groupBy("b1", "b2", "kind", "x", "y").applyInPandas(_link_blocks, _EDGE)
    return reached.unionByName(linked)


def similar_edges(docs: DataFrame, id_col: str, text_col: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Verified edges ``(u, v)``, ``u > v``, of near-duplicate rows, and ``(node, id, text_key)`` of all rows; tables are written below ``path``."""
    spark = docs.sparkSession
    src = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    # a row is a node of its own, whatever its id; Python sees neither
    src = src.select(F.monotonically_increasing_id().alias("node"), "id", _text_key(F.col("text")).alias("text_key"), "text")
    kind = src.schema["id"].dataType
    given = [T.StructField("node", T.LongType()), T.StructField("id", kind), T.StructField("text_key", T.LongType())]
    schema = T.StructType([*given, T.StructField("sig", T.BinaryType()), T.StructField("whole", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    with small_batches(spark):
        signed = written(src.mapInArrow(_sign, schema), f"{path}/signed")
    # rows with one signature are one node for banding
    first = signed.groupBy("whole").agg(F.min("node").alias("v"))
    same = signed.select("node", "whole").join(first, "whole").where("node <> v").select(F.col("node").alias("u"), "v")
    rep = written(signed.join(first.withColumnRenamed("v", "node"), ["whole", "node"], "left_semi").select("node", "sig", "bands"), f"{path}/rep")
    # narrow rows: a bucket key and a node.  A bucket's size and the digest (b1, b2) of its members come from a window, which spills; large ones are collected in chunks
    rows = rep.select("node", F.posexplode("bands").alias("band", "key"))
    w = Window.partitionBy("band", "key")
    rows = rows.withColumns({"n": F.count("*").over(w), "b1": F.bit_xor(F.xxhash64("node", F.lit(1))).over(w), "b2": F.bit_xor(F.xxhash64("node", F.lit(2))).over(w)}).where("n > 1")
    rows = rows.withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int"))
    buckets = rows.groupBy("band", "key", "chunk").agg(F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.first("chunks").alias("chunks"), F.sort_array(F.collect_list("node")).alias("nodes"))
    # many bands hold the same documents: compare each distinct set once
    sets = written(buckets.groupBy("b1", "b2", "chunk").agg(F.first("chunks").alias("chunks"), F.first("nodes").alias("nodes")), f"{path}/buckets")
    small = sets.where("chunks = 1")
    cells = max(1, (small.agg(F.sum(F.size("nodes"))).first()[0] or 0) // CELL_MEMBERS)
    members = small.select("b1", "b2", F.pmod(F.xxhash64("b1", "b2"), F.lit(cells)).alias("cell"), F.explode("nodes").alias("node"))
    linked = members.join(rep.select("node", "sig"), "node").groupBy("cell").applyInPandas(_link, _EDGE)
    large = _large(sets, rep, path)
    edges = written((linked.unionByName(large) if large else linked).unionByName(same).distinct(), f"{path}/edges")
    for t in ("rep", "buckets", "large"):  # not read again
        drop_path(spark, f"{path}/{t}")
    return edges, signed.select("node", "id", "text_key")


def _text_key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges ``(u, v)``, ``u > v``, one row each."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:  # neighbours above u move to the least neighbour
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its lower neighbours move to the least of them
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, path: str) -> DataFrame:
    """``(id, component)`` for every id on an edge; the component is its least id.

    Alternates large-star and small-star until the edges no longer change.  Least
    neighbours come from partially aggregated minima and a join, so a node with very
    many neighbours is never collected in one place.
    """
    spark = edges.sparkSession
    state, old, n = None, None, 0
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == state or not mark["n"]:
            break
        state = (mark["n"], mark["h"])
        new = f"{path}/cc-{n}"
        edges = written(_star(_star(edges, True), False), new)
        if old:
            drop_path(spark, old)
        old, n = new, n + 1
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``(id, text_key, group_id, kept)``, one row for each row of ``docs`` that is in a group."""
    edges, rows = similar_edges(docs, id_col, text_col, path)
    found = components(edges, path)
    grouped = written(rows.join(found.withColumnRenamed("id", "node"), "node"), f"{path}/grouped")
    least = grouped.groupBy("component").agg(F.min("id").alias("group_id"))
    own = grouped.join(least, "component").where("id = group_id")
    own = own.groupBy("component").agg(F.min("text_key").alias("k")).join(own, "component").where("text_key = k")
    kept = own.groupBy("component").agg(F.min("node").alias("keep"), F.first("group_id").alias("group_id"))
    return grouped.join(kept, "component").select("id", "text_key", "group_id", (F.col("node") == F.col("keep")).alias("kept"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, group_id, kept)`` for each row that has a near copy.

    ``group_id`` is the least id of the group, whose row is the one kept; of several rows
    with that id in the group it is one with the least hash of its text.  Rows without a
    near copy are absent.  Rows with a null id or null text, and texts without a word
    character (empty ones too), are like no other row.  Rows are compared by their
    text, so rows that repeat an id are documents of their own, and rows that repeat
    id and text are copies of each other.  Texts of any length are read whole.
    Extra columns are not read, so their names cannot clash.  No rows give no rows.
    """
    path = shared_dir(docs.sparkSession)
    out = _groups(docs, id_col, text_col, path)
    return out.select(F.col("id").alias("doc_id"), "group_id", "kept")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, see near_groups; columns unchanged, whatever their names."""
    path = shared_dir(docs.sparkSession)
    sealed = Sealed(docs)
    rows = _groups(docs, id_col, text_col, path).groupBy(F.col("id").alias("gi"), F.col("text_key").alias("gt")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    rows = written(rows, f"{path}/decided")
    key = _text_key(sealed.col(text_col).cast("string"))
    gone = rows.where("NOT kept")
    out = sealed.df.join(small_side(gone, gone.count()), (sealed.col(id_col) == F.col("gi")) & (key == F.col("gt")), "left_anti")
    again = rows.where("kept AND n > 1")  # rows that repeat id and text: one of them stays
    if repeats := again.count():
        out = out.join(small_side(again.drop("kept"), repeats), (sealed.col(id_col) == F.col("gi")) & (key == F.col("gt")), "left")
        one = out.where("n IS NOT NULL").dropDuplicates(["gi", "gt"])
        out = out.where("n IS NULL").unionByName(one)
    return sealed.open(out)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All near-duplicate groups of ``documents``."""
    return near_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
ORACLE: dict[str, str] = {}
