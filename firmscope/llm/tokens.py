"""Token ids: encoding with a public vocabulary, and files of ids whose document bounds are Elias-Fano coded.

A file block holds the ids of consecutive documents as little-endian 16- or 32-bit
integers, one array after another, and the ends of the documents in that array as an
Elias-Fano code: of each end the low bits verbatim, and the high bits in unary in one
bit string, in which every 64th set bit's place is noted. `BoundReader.select` finds
an end from that note and at most a few machine words, so no table of 64-bit offsets
is kept: about 2 + log2(ids / documents) bits a document.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, stage, tokenizer_path

# ---------------------------------------------------------------- encoding

#: Texts whose white space is more than single plain spaces and line feeds between other characters, or that hold our own marks.
_UNEVEN = r"  | \n|\n |\n\n|^[ \n]|[ \n]$|[\x{00}\x{01}\t\x{0b}\x{0c}\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")
#: Letters whose normal form is the letter itself (small or not), so that a word of them is one run for every vocabulary here.
_PLAIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD, _ENDED = f"^[{_PLAIN}]+$", f"[{_PLAIN}]$"

#: CUT stands between the pieces of a text, RAW before one that has no space in front.
CUT, RAW = "\0", "\1"
#: Stands between pieces that the library encodes in one call; pieces that hold it are encoded by themselves.
BAR = RAW


def _strings(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Encodes whole texts with a vocabulary of the tokenizers library.

    A vocabulary splits a text before it merges, and never over a single space between
    two other characters. So texts are cut there, each different piece is encoded once
    by the library, and the pieces' ids are joined: the ids are those of the whole text,
    and a very long text never becomes one call. Arrow cuts the texts and finds the
    different pieces of a portion; what they stand for is remembered over portions and,
    as one encoder serves a whole Python worker (`encoder`), over tasks.

    `keeps_space`: the space belongs to the piece behind it (byte-level vocabularies), or is
    dropped (word vocabularies, which also make letters small). `most`: pieces remembered;
    those not met for half as many new ones are forgotten. Strings of special tokens in a text
    are ordinary text (`encode_special_tokens`, as the vocabularies' notes advise), so that no text can
    plant an end of document; `special=True` gives them their own ids, as a plain call does.
    """

    def __init__(self, path: str, keeps_space: bool, most: int = 900_000, longest: int = 24, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()] if special else []
        self.model = self.library.model
        self.keeps_space, self.most, self.longest = keeps_space, most, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        letters = re.findall(f"[{_PLAIN}]", "".join(map(chr, range(0xC0, 0x100))))
        self.letters = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in letters}
        self.lead = as_bytes.pre_tokenize_str(" ")[0][0] if keeps_space else ""
        self.bar = self.library.encode(" " + BAR, add_special_tokens=False).ids

    def _ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A word of plain letters: at most to be made small and nothing to split, so the vocabulary's model takes it as it is."""
        word = word if self.keeps_space else word.lower()
        return array("I", [t.id for t in self.model.tokenize(self.lead + (word if word.isascii() else word.translate(self.letters)))]).tobytes()

    def _written(self, piece: str) -> str:
        """What a piece stands for in the text."""
        if not self.keeps_space:
            return piece
        return piece[1:] if piece[:1] == RAW else piece if piece[:1] == "\n" else " " + piece

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't words: one call for all, with a bar between them that no piece holds."""
        odd = [p for p in pieces if not p or BAR in p or p.lstrip("\n")[:1].isspace() or p[-1].isspace() or p.startswith("\n\n")]
        found = {p: self._ids(self._written(p)) if p != "" or self.keeps_space else b"" for p in odd}
        even = [p for p in pieces if p not in found]
        for i in range(0, len(even), 4096):
            some = even[i : i + 4096]
            text = f" {BAR}".join([p if p[0] == "\n" else " " + p for p in some])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            bars = np.flatnonzero(ids == self.bar[-1])
            starts, ends, raw = [0, *(4 * (bars + 1)).tolist()], [*(4 * (bars + 1 - len(self.bar))).tolist(), 4 * len(ids)], ids.tobytes()
            found.update((p, raw[i:j]) for p, i, j in zip(some, starts, ends, strict=True))
        return found

    def _pieces(self, texts: pa.Array) -> pa.Array:
        """Of each text the list of its pieces."""
        if not self.keeps_space:
            return pc.split_pattern(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), " ")
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_pylist()
        marked = [
            RAW + (CUT.join([p[1:] if i else p for i, p in enumerate(_BETWEEN.split(t))]) if odd else t.replace("\n", " \n").replace(" ", CUT)) for t, odd in zip(_strings(texts), uneven, strict=True)
        ]
        return pc.split_pattern(pa.array(marked, pa.string()), CUT)

    def _all_ids(self, pieces: pa.Array) -> list[bytes]:
        """Of each of these different pieces the ids."""
        known, older = self.known, self.older
        names = _strings(pieces)
        found = list(map(known.get, names))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            missing = pieces.take(pa.array(new))
            stems = pc.utf8_rtrim(missing, ".,")  # every vocabulary splits between a plain letter and what isn't one
            plain, ended = pc.match_substring_regex(stems, _WORD).to_pylist(), pc.match_substring_regex(stems, _ENDED).to_pylist()
            more: dict[str, bytes] = {}
            later: list[tuple[str, str]] = []
            ask: list[str] = []
            for p, s, word, cut in zip(_strings(missing), _strings(stems), plain, ended, strict=True):
                if (ids := older.get(p)) is not None:
                    more[p] = ids
                    continue
                ids = known.get(s) or older.get(s) or more.get(s)
                if ids is None and word:
                    more[s] = ids = self._word(s)
                if ids is None or not cut:
                    ask.append(s if cut else p)
                    if cut and s != p:
                        later.append((p, s))
                elif s != p:
                    more[p] = ids + self._mark(p[len(s) :])
                else:
                    more[p] = ids
            more.update(self._learn([p for p in set(ask) if p not in more]))
            for p, s in later:
                more[p] = more[s] + self._mark(p[len(s) :])
            for i in new:
                found[i] = more[names[i]]
            known.update([x for x in more.items() if len(x[0]) <= self.longest])
            if len(known) > self.most // 2:
                self.known, self.older = {}, known
        return found

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._ids(mark)
        return self.marks[mark]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another (unsigned 32-bit), and where each text's ids end."""
        apart = [False] * len(texts)
        marks = [CUT, RAW] if self.keeps_space else []
        if any(pc.any(pc.match_substring(texts, s)).as_py() for s in marks + self.special):  # rare, so in one call each
            apart = [any(s in t for s in marks + self.special) for t in texts.to_pylist()]
            whole = {i: np.frombuffer(self._ids(texts[i].as_py()), "<u4") for i, a in enumerate(apart) if a}
            texts = pc.if_else(pa.array(apart), "", texts)
        pieces = self._pieces(texts)
        coded = pc.dictionary_encode(pieces.flatten())
        at = coded.indices.to_numpy()
        of = self._all_ids(coded.dictionary)
        size = np.fromiter(map(len, of), np.int64, len(of)) // 4
        flat, begin = np.frombuffer(b"".join(of), "<u4"), np.cumsum(size) - size
        each = size[at]
        total = np.concatenate(([0], np.cumsum(each)))
        ids = flat[np.repeat(begin[at] - total[:-1], each) + np.arange(total[-1])]
        ends = total[pieces.offsets.to_numpy()[1:] - pieces.offsets[0].as_py()]
        if any(apart):
            starts = np.concatenate(([0], ends[:-1]))
            parts = [whole[i] if a else ids[starts[i] : ends[i]] for i, a in enumerate(apart)]
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, ends


@lru_cache(maxsize=1)
def encoder(path: str, keeps_space: bool, most: int = 900_000) -> Encoder:
    """The encoder of this Python worker, which the tasks that it runs share one after another."""
    return Encoder(path, keeps_space, most)


def in_portions(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts (null: empty) of about `most` bytes at most; one longer text is a run of its own."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    held = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(texts):
        before = held[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(held, before + most, side="right")))
        yield start, texts.slice(start, end - start)
        start = end


# ---------------------------------------------------------------- Elias-Fano

EVERY = 64


def ef_encode(ends: np.ndarray) -> bytes:
    """Code a non-decreasing array of unsigned integers."""
    ends = np.asarray(ends, np.uint64)
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n and top >= n else 0
    low = (ends & np.uint64((1 << low_bits) - 1)).astype(np.uint64)
    bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
    high[ones] = 1
    highs = np.packbits(high, bitorder="little").tobytes()
    highs += b"\0" * (-len(highs) % 8)
    notes = ones[::EVERY].astype("<u4").tobytes()
    return struct.pack("<QBII", n, low_bits, len(lows), len(highs)) + lows + highs + notes


class BoundReader:
    """Reads an Elias-Fano code in place."""

    def __init__(self, code: bytes | memoryview):
        self.n, self.low_bits, lows, highs = struct.unpack_from("<QBII", code)
        at = struct.calcsize("<QBII")
        self.lows = np.frombuffer(code, np.uint8, lows, at)
        self.highs = np.frombuffer(code, np.uint8, highs, at + lows)
        self.notes = np.frombuffer(code, "<u4", -(-self.n // EVERY), at + lows + highs)

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        few = self.lows[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes()
        return int.from_bytes(few, "little") >> (at & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value, from the nearest note before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.notes[i // EVERY]), i % EVERY
        byte = at >> 3
        word = int(self.highs[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every value, for a scan of the block."""
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low_bits]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return high | (bits.reshape(self.n, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)


# ---------------------------------------------------------------- the file block

MAGIC = b"EFIDS1\0\0"


def write_block(ids: list[bytes], wide: bool) -> bytes:
    """One block: the documents' ids (each as 32-bit integers) and their coded ends."""
    ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.uint64)
    flat = np.frombuffer(b"".join(ids), "<u4").astype("<u4" if wide else "<u2").tobytes()
    flat += b"\0" * (-len(flat) % 8)
    code = ef_encode(ends)
    return MAGIC + struct.pack("<BxxxxxxxQQ", 4 if wide else 2, len(flat), len(code)) + flat + code


class Block:
    """Gives any document's ids of a block by select on its coded bounds."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a block of token ids")
        width, flat, code = struct.unpack_from("<BxxxxxxxQQ", data, 8)
        self.bounds = BoundReader(memoryview(data)[32 + flat : 32 + flat + code])
        total = self.bounds.select(self.bounds.n - 1) if self.bounds.n else 0
        self.ids = np.frombuffer(data, "<u4" if width == 4 else "<u2", total, 32)

    def __len__(self) -> int:
        return self.bounds.n

    def document(self, i: int) -> tuple[int, np.ndarray]:
        """Start and ids of any one document, by select."""
        start = self.bounds.select(i - 1) if i else 0
        return start, self.ids[start : self.bounds.select(i)]

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """Start and ids of all documents in turn, from one scan of the bounds."""
        start = 0
        for end in self.bounds.all().astype(np.int64).tolist():
            yield start, self.ids[start:end]
            start = end


# ---------------------------------------------------------------- as DataFrames

BLOCKS = "part int, block long, doc_ids array<bigint>, n_ids long, data binary"


def write_token_blocks(docs: DataFrame, vocabulary: str, keeps_space: bool, end_id: int, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 1 << 20) -> DataFrame:
    """Encode all texts and write them as blocks, in ascending order of `id_col`; returns the written blocks.

    The texts are dealt by ranges of the id and sorted, so each task writes consecutive
    documents; a block closes at `block_ids` ids, so memory stays bounded (one document
    is never split: a longer one has a block to itself). Null text: empty, its only id is
    `end_id`. Null ids come first. Repeated ids: each row is a document.
    """
    wanted = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    dealt = wanted.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path(vocabulary), keeps_space)
        wide = coder.library.get_vocab_size() > 1 << 16 or end_id >= 1 << 16
        end, schema = np.array([end_id], "<u4").tobytes(), pa.schema([("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("data", pa.binary())])
        ids: list[int | None] = []
        held: list[bytes] = []
        part = number = size = 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([write_block(held, wide)], pa.binary())], schema=schema)

        for batch in batches:
            docs_of = batch.column(1).to_pylist()
            if len(docs_of):
                part = batch.column(0)[0].as_py()
            for first, some in in_portions(batch.column(2)):
                flat, ends = coder.encode(some)
                raw, begin = flat.tobytes(), 0
                for d, upto in zip(docs_of[first:], ends.tolist(), strict=False):
                    ids.append(d)
                    held.append(raw[4 * begin : 4 * upto] + end)
                    size += upto - begin + 1
                    begin = upto
                    if size >= block_ids:
                        yield close()
                        ids, held, size, number = [], [], 0, number + 1
        if held:
            yield close()

    return stage(dealt.mapInArrow(encode, BLOCKS), "token-ids")


def read_token_blocks(blocks: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Blocks are numbered within the task that wrote them and tasks by range, so a block's
    start is the sum within its task before it plus the totals of the tasks before; only
    those totals (one row a task) meet in one place.
    """
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(totals, "part")
    starts = starts.select("part", "block", (F.col("inside") + F.col("before")).alias("base"))

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, docs_of, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = Block(data.as_py())
                rows = list(block.documents())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs_of, pa.int64()),
                        pa.array([base + s for s, _ in rows], pa.int64()),
                        pa.array([len(x) for _, x in rows], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in rows], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    placed = blocks.join(starts, ["part", "block"]).select("base", "doc_ids", "data")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
