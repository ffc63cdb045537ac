"""Packing token runs into windows by best-fit decreasing.

Best fit decreasing treats pieces of equal length alike, and so windows with equal
histories. The plan is therefore made from the count of pieces of each length (at most
`window` numbers, whatever the corpus): lengths descend, and each finds the tightest
open windows that still take it by a segment tree indexed by remaining capacity. Runs
of alike windows are filled in one step, so the plan has a few thousand rows. Pieces
then get their rank among the pieces of their length, and the plan's row of that rank
gives window and offset.

Texts that come in an order to be kept (a mixture's schedule) are packed stretch by stretch
of that order, and windows are numbered in it: the windows up to the end of a stretch hold
the texts up to there and no others, so the shares of sources that the order holds also hold
for the windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, rank_in_group, stage, tokenizer_path
from .tokens import encoder, in_portions

#: Texts of an ordered table that are packed together: at least so many, and more where there would be over STRETCHES stretches.
STRETCH_TEXTS, STRETCHES = 8192, 32
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


class TightestFit:
    """A segment tree over capacities 0..window that finds the least open capacity of at least n."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.open = [0] * (2 * self.leaves)

    def change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.open[at] += by
            at >>= 1

    def find(self, least: int) -> int | None:
        """Climb while nothing on the right is open, then descend to the leftmost open leaf."""
        at = least + self.leaves
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first sequence, pieces a sequence, offset).

    The pieces of that length with ranks from the first on go `pieces a sequence` at a time
    into the sequences from the first on, side by side from the offset.
    """
    tree = TightestFit(window)
    runs: dict[int, list[tuple[int, int]]] = {}  # remaining capacity: runs (first sequence, how many) of open windows
    plan, opened = [], 0

    def put(capacity: int, first: int, many: int) -> None:
        if many and capacity:
            runs.setdefault(capacity, []).append((first, many))
            tree.change(capacity, many)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.find(length)
            if capacity is None:  # no open window takes it: open as many as these pieces need
                capacity, each = window, window // length
                first, many = opened, -(-left // each)
                opened += many
            else:
                first, many = runs[capacity].pop()
                tree.change(capacity, -many)
                each = capacity // length
            full = min(many, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, window - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < many:  # the last window takes what is left; left < each
                plan.append((length, rank, left, first + full, left, window - capacity))
                put(capacity - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(capacity, first + full, many - full)
    return plan


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int, id_col: str = "doc_id", text_col: str = "text", remember: int = 900_000, place_col: str | None = None) -> DataFrame:
    """Encode each whole text, append the end id, cut into full windows and a rest; one row a piece.

    Null or empty text: one piece that holds the end id alone. place_col: a long that goes along as `place`.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer_path(vocabulary), False, remember), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids_of, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, some in in_portions(batch.column(1)):
                flat, ends = coder.encode(some)
                raw, begin = flat.tobytes(), 0
                out: list[list] = [[], [], [], [], [], []]
                for d, place, upto in zip(ids_of[first:], places[first:], ends.tolist(), strict=False):
                    ids = raw[4 * begin : 4 * upto] + end
                    begin = upto
                    for at in range(0, len(ids), 4 * window):
                        piece = ids[at : at + 4 * window]
                        for k, v in enumerate((d, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, place)):
                            out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=[*PIECE_COLUMNS, "place"])

    place = column(docs, place_col).cast("long") if place_col else F.lit(None).cast("long")
    wanted = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"), place.alias("place"))
    pieces = wanted.mapInArrow(encode, PIECES + ", place long")
    return pieces if place_col else pieces.drop("place")


def pack(pieces: DataFrame, window: int) -> DataFrame:
    """Add sequence_id and offset to staged pieces (columns of PIECES; lengths 1 to `window`).

    Equal lengths are ranked by doc_id, start and checksum; pieces equal in all of them
    (repeated rows) change places freely. Sequences are filled from offset 0 without gaps.
    With a column place (numbers of the texts from 0), pieces are packed by stretches of it,
    equal lengths are ranked by it, and the sequences of a stretch follow those before it.
    """
    ordered = "place" in pieces.columns
    last = pieces.agg(F.max("place")).first()[0] if ordered else None
    texts = max(STRETCH_TEXTS, -(-((last or 0) + 1) // STRETCHES))
    pieces = pieces.withColumn("stretch", F.floor(F.col("place") / texts).cast("int") if ordered else F.lit(0))
    counts: dict[int, dict[int, int]] = {}
    for r in pieces.groupBy("stretch", "length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `window` rows a stretch
        counts.setdefault(r["stretch"], {})[r["length"]] = r["n"]
    plan, opened = [], 0
    for stretch in sorted(counts):
        part = best_fit_plan(counts[stretch], window)
        plan += [(stretch, length, rank, n, opened + first, each, offset) for length, rank, n, first, each, offset in part]
        opened += max(first - (-n // each) for _, _, n, first, each, _ in part)
    schema = "p_stretch int, p_length int, p_rank long, p_pieces long, p_sequence long, p_each long, p_offset long"
    rows = pieces.sparkSession.createDataFrame(plan, schema)  # bounded by the window and STRETCHES, not by the data
    ranked = rank_in_group(pieces, ["stretch", "length"], "place" if ordered else "doc_id", ["start", "ids_crc32"], "rank")
    fits = (F.col("stretch") == F.col("p_stretch")) & (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_pieces"))
    into = F.col("rank") - F.col("p_rank")
    return ranked.join(F.broadcast(rows), fits).select(
        *[F.col(c).cast("long").alias(c) for c in PIECE_COLUMNS],
        (F.col("p_sequence") + F.floor(into / F.col("p_each"))).cast("long").alias("sequence_id"),
        (F.col("p_offset") + into % F.col("p_each") * F.col("length")).cast("long").alias("offset"),
    )


PIECE_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", remember: int = 900_000, place_col: str | None = None) -> DataFrame:
    """Encode, cut, pack: one row a piece. An empty table gives no rows. remember: words whose ids a task keeps at hand. place_col: numbers of the texts from 0, an order to keep."""
    pieces = stage(token_pieces(docs, vocabulary, end_id, window, id_col, text_col, remember, place_col), "pieces")
    return pack(pieces, window)
