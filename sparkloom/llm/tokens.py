"""Token counts with a map-side two-tier lookup.

Tier 1 is a compact table of frequent pre-tokens and their token counts, broadcast once.
By default it comes from the vocabulary file itself, whose entries are the pieces that
were frequent where it was made; ``frequent_table`` makes one from all rows of a
corpus, in a pass of its own, to be stored beside it: every task keeps a bounded summary
of its pre-tokens (Misra-Gries, which never loses one above its share) and only the
summaries are merged.  Tier 2 is a cache in each Python worker that encodes a
pre-token the first time it is missed.  No pre-token is ever shuffled, texts are read
once, and whatever tier 1 holds changes speed only, never a count.
"""

from __future__ import annotations

import base64
import itertools
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, drop_path, shared_dir, table, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split into pre-tokens that the vocabulary was made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens that a task's summary keeps, entries of the broadcast table, entries of a worker's cache and characters of one.
SUMMARY, FREQUENT, CACHE, KEPT_CHARS = 8192, 65_536, 400_000, 64


def read_ranks(path: str = VOCABULARY) -> bytes:
    """The vocabulary file's bytes, compressed for broadcast."""
    with open(path, "rb") as f:
        return zlib.compress(f.read())


def encoding(packed: bytes) -> tiktoken.Encoding:
    lines = zlib.decompress(packed).splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def compact(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    """(pre-tokens joined by a byte that UTF-8 never uses, their token counts) compressed."""
    return zlib.compress(b"\xff".join(k.encode("utf-8", "surrogatepass") for k in lengths)), zlib.compress(np.array(list(lengths.values()), np.uint32).tobytes())


def expand(packed: tuple[bytes, bytes]) -> dict[str, int]:
    keys, values = zlib.decompress(packed[0]), np.frombuffer(zlib.decompress(packed[1]), np.uint32)
    return dict(zip([k.decode("utf-8", "surrogatepass") for k in keys.split(b"\xff")], values.tolist())) if len(values) else {}


class Counts(dict):
    """pre-token -> tokens: starts as the frequent table; misses are encoded once and kept until the cache is full.

    Pre-tokens longer than KEPT_CHARS are encoded each time, which bounds the cache in
    bytes.  A miss is merged as one piece, without the split expression, so a run of
    a million blanks is a piece like any other.
    """

    def __init__(self, frequent: dict[str, int], packed_ranks: bytes):
        super().__init__(frequent)
        self.frequent, self.limit = frequent, len(frequent) + CACHE
        self.encode = encoding(packed_ranks)._encode_single_piece

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= KEPT_CHARS:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


_state: dict[str, tuple] = {}


def _counts(key: str, ranks, frequent) -> Counts:
    """The worker's lookup, kept between tasks of one job."""
    if key not in _state:
        _state.clear()
        _state[key] = Counts(expand(frequent.value), ranks.value)
    return _state[key]


def split_pattern():
    import regex

    return regex.compile(PATTERN)


def summarise(texts: Iterator[str], size: int = SUMMARY) -> Counter:
    """Misra-Gries summary of all pre-tokens of ``texts``: counts too low by at most ``total / size``."""
    find, seen = split_pattern().findall, Counter()
    for text in texts:
        seen.update(find(text))
        if len(seen) > 16 * size:
            cut = sorted(seen.values(), reverse=True)[size]
            seen = Counter({k: n - cut for k, n in seen.items() if n > cut})
    if len(seen) > size:
        cut = sorted(seen.values(), reverse=True)[size]
        seen = Counter({k: n - cut for k, n in seen.items() if n > cut})
    return seen


def vocabulary_table(packed: bytes) -> dict[str, int]:
    """The vocabulary's entries that are whole pre-tokens, each of one token."""
    whole, out = split_pattern().fullmatch, {}
    for line in zlib.decompress(packed).splitlines():
        try:
            piece = base64.b64decode(line.split()[0]).decode()
        except (IndexError, UnicodeDecodeError):  # a blank line, or part of a character
            continue
        if whole(piece):
            out[piece] = 1
    return out


def frequent_table(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> dict[str, int]:
    """The frequent pre-tokens of all rows with their token counts, to be kept with the corpus (see compact)."""
    path = shared_dir(docs.sparkSession)

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = summarise(itertools.chain.from_iterable(pdf["text"] for pdf in batches))
        yield pd.DataFrame({"piece": [k.encode("utf-8", "surrogatepass") for k in seen], "n": list(seen.values())})

    texts = docs.select(col(text_col).cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    merged = written(texts.mapInPandas(summary, "piece binary, n long"), f"{path}/summaries").groupBy("piece").agg(F.sum("n").alias("n"))
    # bounded by FREQUENT rows, whatever the corpus
    top = [bytes(r.piece).decode("utf-8", "surrogatepass") for r in merged.orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()]
    drop_path(docs.sparkSession, path)
    count = Counts({}, read_ranks(vocabulary)).__missing__
    return {p: count(p) for p in top}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, frequent: dict[str, int] | None = None) -> DataFrame:
    """``(doc_id, n_tokens)``, one row for each row of ``docs``, read once.

    The count is that of encoding the whole text with no special tokens; a null text
    has a null count, an empty text 0.  Ids of any type pass through as they are, null
    ids too; repeated rows are counted each.  Texts of any length, and runs of any one
    character, are counted whole.  Extra columns are not read.  No rows give no rows.
    ``frequent`` is tier 1, by default that of the vocabulary.
    """
    sc = docs.sparkSession.sparkContext
    packed = read_ranks(vocabulary)
    table_key = uuid.uuid4().hex
    ranks, tier = sc.broadcast(packed), sc.broadcast(compact(vocabulary_table(packed) if frequent is None else frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, lookup = split_pattern().findall, _counts(table_key, ranks, tier).__getitem__
        for batch in batches:
            n = [None if t is None else sum(map(lookup, find(t))) for t in (x.as_py() for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE: dict[str, str] = {}
