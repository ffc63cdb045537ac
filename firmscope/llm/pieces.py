"""SentencePiece encoding by a table of distinct chunks, and decoding.

The library marks white space with a character of its own. If no piece of a model holds that mark
behind another character, no piece crosses from one marked word into the next, so a text is cut
into chunks before each run of marks, each distinct chunk is segmented once, and the ids of a
text are those of its chunks, taken from the table by position.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, tokenizer_path
from .tokens import in_portions

MARK = "▁"
_CHUNK = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


class ChunkTable:
    """Segments whole texts with a SentencePiece model.

    Each distinct chunk of a portion is segmented once at most. Up to `most` chunks of at most `longest` characters are
    remembered over portions and, as one table serves a Python worker, over tasks; those not met for half as many
    new ones are forgotten. A model whose pieces can cross a mark, or that changes texts before it marks them, is refused.
    """

    def __init__(self, path: str, most: int = 500_000, longest: int = 16):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rule = model.normalizer_spec
        if rule.precompiled_charsmap or not rule.add_dummy_prefix or rule.remove_extra_whitespaces or not rule.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: texts are changed before white space is marked, so chunks can't be segmented by themselves")
        if any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces):
            raise ValueError(f"{path}: pieces cross white space, so chunks can't be segmented by themselves")
        if any(p.type == p.USER_DEFINED for p in model.pieces):
            raise ValueError(f"{path}: pieces of the user's own are matched before chunks")
        if self.library.is_unknown(self.library.piece_to_id(MARK)):
            raise ValueError(f"{path}: no piece for a mark by itself")
        self.end, self.mark = self.library.eos_id(), self.library.piece_to_id(MARK)
        self.most, self.longest = most, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _segment(self, chunks: list[str]) -> dict[str, bytes]:
        """The library puts the first mark of a text there itself, so a chunk goes to it without its own; one mark at a text's end is left alone."""
        found = {}
        for i in range(0, len(chunks), 8192):
            some = chunks[i : i + 8192]
            ids = self.library.encode([c[1:] for c in some], num_threads=1)
            found.update(zip(some, [array("i", x).tobytes() for x in ids], strict=True))
        for c in (" ", MARK):
            if c in found:
                found[c] = array("i", [self.mark]).tobytes()
        return found

    def _learn(self, chunks: set[str]) -> None:
        """Have all of these in the table: from the older half, or segmented now."""
        more = {c: f for c in chunks if (f := self.older.get(c)) is not None}
        self.known.update(more)
        self.known.update(self._segment([c for c in chunks if c not in more] if more else list(chunks)))

    def encode(self, texts: list[str], end: bool = True) -> pa.ListArray:
        """The ids of each text, with the end id behind them."""
        chunks = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        new = set(chain.from_iterable(chunks)).difference(self.known)
        if new:
            self._learn(new)
        table, mark = self.known.__getitem__, array("i", [self.end] * end).tobytes()
        ids = [b"".join(map(table, some)) + mark for some in chunks]
        for c in new:
            if len(c) > self.longest:
                del self.known[c]
        if len(self.known) > self.most // 2:
            self.known, self.older = {}, self.known
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


@lru_cache(maxsize=1)
def chunk_table(path: str) -> ChunkTable:
    """The table of this Python worker."""
    return ChunkTable(path)


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", out: str = "piece_ids", decoded: str | None = None) -> DataFrame:
    """Adds each text's ids with the end id (null and empty texts: the end id alone), an array of int in a column named like `out`.

    `decoded`: also adds a column with the text that the library decodes from them, in the same pass; the text's own column goes.
    No shuffle: every row is encoded where it is read. Repeated rows stay; an empty table stays empty.
    """
    name, at = fresh(docs, out), docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if not decoded or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(tokenizer_path(model))
        for batch in batches:
            for start, texts in in_portions(batch.column(at), 1 << 20):
                ids = table.encode(texts.to_pylist())
                more = [ids, pa.array(table.decode(ids.to_pylist()), pa.string())] if decoded else [ids]
                own = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*[own.column(i) for i in kept], *more], [*[batch.schema.names[i] for i in kept], name, *[decoded] * bool(decoded)])

    fields = ", ".join(f"`{docs.schema.fields[i].name.replace('`', '``')}` {docs.schema.fields[i].dataType.simpleString()}" for i in kept)
    return docs.mapInArrow(run, f"{fields}, `{name}` array<int>" + (f", `{decoded}` string" if decoded else ""))


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes from each row's ids (null: empty)."""
    name, at = fresh(rows, out), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(tokenizer_path(model))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                texts = table.decode([ids or [] for ids in some.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], [*some.schema.names, name])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{name}` string")


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids (decimal, with one space between) and of the text decoded from them."""
    coded = encode_pieces(docs.select("doc_id", "text"), model, decoded="decoded")
    ids = column(coded, "piece_ids")
    return coded.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
