"""Hierarchical packing of documents into windows of several context sizes.

Documents are routed to the smallest tier that holds them; longer ones than the
largest window are cut into full windows and a rest, which is routed.  The documents
are hashed into cells whose number grows with the documents; a cell is packed on its
own, from the longest tier down:

1. the tier's own pieces, best fit over windows, longest first;
2. gaps left in its windows are filled with pieces of shorter tiers, longest first;
3. the pieces that remain go to their own, shorter tier.

The windows of a tier in a cell are dealt to step groups of equal size, fullest
first to the group with the fewest tokens, so that groups carry nearly equal tokens.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, shared_dir, small_batches, table, written
from .tokens import count_tokens

#: Window sizes in tokens, shortest first.
TIERS = (512, 2048, 8192)
#: Tokens added to each document as its end mark.
END_TOKENS = 1
#: Documents of a cell on average, and windows of a step group.
CELL_DOCS, GROUP_WINDOWS = 8192, 16

SCHEMA = "doc_id {}, piece int, start long, length long, tier int, cell int, window_no int, offset long, step_group int"


def pack_cell(lengths: list[int], tiers: tuple[int, ...] = TIERS, group_windows: int = GROUP_WINDOWS) -> list[tuple]:
    """Rows (index into lengths, piece, start, length, tier, window, offset, group) of one cell."""
    top = tiers[-1]
    own: list[list[tuple[int, int, int, int]]] = [[] for _ in tiers]
    for i, n in enumerate(lengths):
        full, rest = divmod(n, top)
        for k in range(full):
            own[-1].append((top, i, k, k * top))
        if rest:
            own[bisect_left(tiers, rest)].append((rest, i, full, full * top))
    for pieces in own:
        pieces.sort(key=lambda x: (-x[0], x[1], x[2]))
    rows, window = [], 0
    for t in range(len(tiers) - 1, -1, -1):
        room: list[tuple[int, int]] = []  # (tokens left, window), least room first
        used: dict[int, int] = {}
        size = tiers[t]

        def put(piece: tuple, at: int, size: int = size, t: int = t, room: list = room, used: dict = used) -> None:
            left, w = room.pop(at)
            n, i, k, start = piece
            rows.append((i, k, start, n, t, w, used[w]))
            used[w] += n
            if left > n:
                insort(room, (left - n, w))

        for piece in own[t]:
            at = bisect_left(room, (piece[0], -1))
            if at == len(room):
                used[window] = 0
                insort(room, (size, window))
                at = bisect_left(room, (piece[0], -1))
                window += 1
            put(piece, at)
        for s in range(t - 1, -1, -1):  # gaps of this tier
            stay = []
            for piece in own[s]:
                at = bisect_left(room, (piece[0], -1))
                if at < len(room):
                    put(piece, at)
                else:
                    stay.append(piece)
            own[s] = stay
        own[t] = list(used.items())  # windows with their tokens
    group, of = 0, {}
    for t in range(len(tiers) - 1, -1, -1):
        windows = sorted(own[t], key=lambda x: (-x[1], x[0]))
        groups = -(-len(windows) // group_windows)
        load = [(0, 0, g) for g in range(groups)]  # (windows, tokens, group): groups stay equal in size within one window
        for lo in range(0, len(windows), max(groups, 1)):
            load.sort(key=lambda x: (x[1], x[2]))
            for j, (w, n) in enumerate(windows[lo : lo + groups]):
                c, tokens, g = load[j]
                load[j] = (c + 1, tokens + n, g)
                of[w] = group + g
        group += groups
    return [(*r[:4], tiers[r[4]], r[5], r[6], of[r[5]]) for r in rows]


def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("id", "ascending"), ("length", "ascending")])  # nulls last
    packed = pack_cell(rows.column("length").to_pylist())
    i, piece, start, length, tier, window, offset, group = map(list, zip(*packed))
    made = [pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (tier, pa.int32()), ([rows.column("cell")[0].as_py()] * len(i), pa.int32()), (window, pa.int32()), (offset, pa.int64()), (group, pa.int32()))]
    return pa.Table.from_arrays([rows.column("id").take(pa.array(i)), *made], [c.split()[0] for c in SCHEMA.split(", ")])


def pack(docs: DataFrame, length: Column, id_col: str = "doc_id") -> DataFrame:
    """One row a piece: its document, token range, tier, window (``cell``, ``window_no``), offset there and step group.

    ``length`` is the token count.  The pieces of a document cover it once, without
    gaps; no window holds more than its tier.  A length of 0 or less, or null, gives no
    piece.  Ids of any type that sorts pass through as they are.  Rows that repeat an id
    are packed each, null ids too.  Ties go by id, nulls last, then length.  Extra columns
    are not read.  No rows give no rows.
    """
    rows = docs.select(col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("length")).where("length > 0")
    # rows alike in id and length are interchangeable: numbered, so that however many there are (null ids, say) they make no hot cell
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("id", "length").orderBy(F.lit(1))))
    rows = written(rows, f"{shared_dir(docs.sparkSession)}/lengths")
    cells = max(1, -(-rows.count() // CELL_DOCS))
    cell = F.pmod(F.xxhash64("id", "length", F.expr(f"nth div {CELL_DOCS}")), F.lit(cells)).cast("int")
    return rows.select("id", "length", cell.alias("cell")).groupBy("cell").applyInArrow(_pack, SCHEMA.format(rows.schema["id"].dataType.simpleString()))


def pack_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` by the texts' own token counts (tokens.count_tokens, one count a row) and an end mark each.

    A null text counts as empty; an empty text is its end mark alone.
    """
    with small_batches(docs.sparkSession):  # pack() writes the counts before it returns
        counts = count_tokens(docs, id_col, text_col)
        return pack(counts, F.coalesce("n_tokens", F.lit(0)) + END_TOKENS)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into windows of all tiers, in tokens of the shipped vocabulary."""
    return pack_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLE: dict[str, str] = {}
