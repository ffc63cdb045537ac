"""Near-duplicate groups by MinHash bands, sequential Bayesian verification and exact confirmation.

Documents are sets of distinct runs of five words. Texts with the same words in the same
order are one representative from the start, so thousands of copies cost one. Representatives
that agree in a band of their signature share a bucket and are candidates. They are compared
in blocks of bounded size inside tasks: a pair is compared one batch of signature places at a
time, and given up as soon as the posterior probability that its similarity reaches the
threshold falls below the chosen miss probability. Survivors are confirmed on their full
sets of word runs, likeliest first, and a pair that links already connect needs no more work.

Two passes look at all candidates without listing the pairs of a group:

1. Stars. A representative goes to the least document that it shares a bucket with, in
   blocks of at most BLOCK that each hold that document too. So a family of thousands of near
   copies is linked by work in proportion to its size, and from then on is one component.
2. Buckets that still hold more than one component. Of their members those of the bucket's
   largest component are compared with the others, and the others among themselves, never
   the largest component's among themselves; again in blocks, any two of which meet in a
   row of their own. These blocks hold no texts but signatures and odd sketches. A pair is
   looked at in the first bucket it shares; what isn't given up is settled by its sketches
   where they prove that it has no link, which leaves hardly more than links. Only the
   documents of pairs left between two components go on to be confirmed, each once for the
   two, so texts aren't dealt by the pairs that merely share buckets.

Any two representatives that share a bucket have then been compared or are in one
component: no link between unconnected documents is left out, and no cap is set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, noting, stage
from .tokens import in_portions

SPAN = 5
BANDS, ROWS = 45, 7
PLACES = BANDS * ROWS
BATCH = 45
#: So many bands find most candidates; the others look only for documents that these leave alone.
EARLY = 9
#: Members and word runs that a block holds, about.
BLOCK, BLOCK_RUNS = 64, 1 << 17
#: Blocks without texts hold so many times more.
WIDER = 16
#: Places of an odd sketch for each word run, at least.
SKETCH_PLACES = 8
#: Where the number of its band begins in a bucket.
BAND_AT = 54
THRESHOLD = (85, 100)
MISS = 1e-7
#: A corpus stage links from 0.8 on. 52 bands of 6 places, all but 3 of the signature's, miss a pair at 0.8 with a chance of 1.4e-7.
STAGE_THRESHOLD, STAGE_BANDS = (80, 100), (52, 6)
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher, place by place."""
    x = (x + np.uint64(_MIX[0])).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draws = (_mixed(np.arange(2 * PLACES, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)
    return draws[:PLACES] | np.uint32(1), draws[PLACES:]


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z made small."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def runs_of(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """The document's set itself: runs of five words, or the whole sequence where there are fewer."""
    if len(words) < SPAN:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + SPAN]) for i in range(len(words) - SPAN + 1)}


def hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes | None]]:
    """Of each text: number of words, sorted 64-bit hashes of its distinct runs, and a 128-bit hash of all its words in order.

    Each different word is hashed once to 128 bits. A run's hash mixes the sum of its words' hashes
    times a multiplier for each place, so neither depends on how letters repeat in a word.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = words.flatten()
    there = pc.greater(pc.binary_length(flat), 0)  # white space around a text leaves empty ones
    upto = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    bounds = upto[words.offsets.to_numpy() - words.offsets[0].as_py()]
    coded = flat.filter(there).dictionary_encode()
    own = [hashlib.blake2b(w, digest_size=16).digest() for w in coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)]
    lanes = np.frombuffer(b"".join(own), np.uint64).reshape(-1, 2)[coded.indices.to_numpy()] if own else np.zeros((0, 2), np.uint64)
    places = _mixed(np.arange(1, SPAN + 1, dtype=np.uint64)) | np.uint64(1)
    first = lanes[:, 0]
    runs = np.zeros(max(0, len(first) - SPAN + 1), np.uint64)
    for k in range(SPAN):
        runs += first[k : k + len(runs)] * places[k]
    runs = _mixed(runs)
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = end - start
        if n >= SPAN:
            mine = np.unique(runs[start : end - SPAN + 1])
        else:
            mine = _mixed((first[start:end] * places[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)) if n else runs[:0]
        yield n, mine, hashlib.blake2b(np.ascontiguousarray(lanes[start:end]), digest_size=16).digest() if n else None


def signature(hashes: np.ndarray) -> bytes:
    """Of each permutation the least hash, as one byte drawn from it.

    A byte tells two different least hashes apart but for one time in 256, which only adds candidates:
    matches grow, so no bound below gives up a pair that it would have kept.
    """
    a, b = _permutations()
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(PLACES, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(small), 64):
        part = small[i : i + 64, None] * a[None, :]
        part += b
        np.minimum(least, part.min(axis=0), out=least)
    return (_mixed(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()


def odd_sketch(hashes: np.ndarray) -> bytes:
    """Of each of so many places (a power of two), whether an odd number of the hashes fall on it.

    Common hashes of two sets cancel each other out: places that differ are no more than hashes that only one of the sets has.
    """
    places = 1 << max(6, (SKETCH_PLACES * len(hashes) - 1).bit_length())
    counts = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places)
    return np.packbits(counts.astype(np.uint8) & 1, bitorder="little").tobytes()


def odd_places(x: tuple[int, int], y: tuple[int, int]) -> int:
    """How many places of two sketches (their bits and number of places) differ; the longer one is folded first."""
    if x[1] < y[1]:
        x, y = y, x
    bits, places = x
    while places > y[1]:
        places //= 2
        bits = (bits >> places) ^ (bits & ((1 << places) - 1))
    return (bits ^ y[0]).bit_count()


@lru_cache(maxsize=8)
def fewest_matches(threshold: float, miss: float, places: int = PLACES, batch: int = BATCH) -> tuple[int, ...]:
    """For each number of places compared so far (batch, 2 * batch, ..), the matches below which a pair is given up.

    With a uniform prior the similarity's posterior after m matches of n is Beta(m + 1, n - m + 1);
    P(similarity >= threshold) is the chance that a Binomial(n + 1, threshold) is at most m.
    """
    out = []
    for n in range(batch, places + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Of pairs of signatures (one a row), the places of those never given up."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(fewest_matches(threshold, miss)):
        at = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[alive, at] == right[alive, at]).sum(axis=1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, words_hash (of all words in order; null without words), signature."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("words_hash", pa.binary()), ("signature", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in in_portions(batch.column(1)):
                sizes, keys, signs = [], [], []
                for n, hashes, key in hashed(some):
                    sizes.append(len(hashes))
                    keys.append(key)
                    signs.append(signature(hashes) if n else None)
                ids = batch.column(0).slice(first, len(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], schema=schema)

    wanted = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return wanted.mapInArrow(run, "doc_id long, n_shingles long, words_hash binary, signature binary")


def buckets_of(signs: np.ndarray, bands: tuple[int, int], numbers: range) -> np.ndarray:
    """Signatures (one a row) to their buckets in these bands: the band's number, then a hash of its places."""
    rows, n = bands[1], len(signs)
    signs = signs[:, numbers.start * rows : numbers.stop * rows].reshape(n, len(numbers), rows).astype(np.uint64)
    own = np.array(numbers, np.uint64)
    bucket = np.broadcast_to(own + np.uint64(1), (n, len(numbers))).copy()
    for k in range(rows):
        bucket = _mixed(bucket ^ signs[:, :, k])
    return ((bucket >> np.uint64(64 - BAND_AT)) | (own << np.uint64(BAND_AT))).view(np.int64)


def in_buckets(reps: DataFrame, bands: tuple[int, int], which: slice) -> DataFrame:
    """Rows with a signature, and longs that go along, to one row for each of some bands: bucket and the longs."""
    numbers = range(*which.indices(bands[0]))
    along = [c for c in reps.columns if c != "signature"]
    schema = pa.schema([(c, pa.int64()) for c in ["bucket", *along]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n or not len(numbers):
                continue
            signs = np.frombuffer(b"".join(batch.column(len(along)).to_pylist()), np.uint8).reshape(n, PLACES)
            bucket = buckets_of(signs, bands, numbers)
            longs = [np.repeat(batch.column(c).to_numpy(), len(numbers)) for c in range(len(along))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket.ravel()), *map(pa.array, longs)], schema=schema)

    return reps.select(*along, "signature").mapInArrow(run, ", ".join(f"{c} long" for c in ["bucket", *along]))


def components(links: DataFrame) -> DataFrame:
    """(doc_id, group) for the documents that have a link: group is the least doc_id reachable.

    Every node points at the least neighbour or what that points at; pointers are followed
    twice a round, so a chain takes rounds as the logarithm of its length. Staged each round.
    """
    both = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("group")), "labels")
    while True:
        near = both.join(label.select(F.col("a").alias("b"), F.col("group").alias("g")), "b").groupBy("a").agg(F.min("g").alias("near"))
        hop = label.join(near, "a").select("a", F.least("group", "near").alias("mid"), F.col("group").alias("old"))
        after = label.select(F.col("a").alias("mid"), F.col("group").alias("far"))
        new = stage(hop.join(after, "mid").select("a", F.least("mid", "far").alias("group"), "old"), "labels")
        settled = new.filter(F.col("group") != F.col("old")).isEmpty()
        label = new.select("a", "group")
        if settled:
            return label.withColumnRenamed("a", "doc_id")


def _likely(left: np.ndarray, right: np.ndarray | None, threshold: float, miss: float, bands: tuple[int, int]) -> list[tuple[int, int]]:
    """Places of the pairs that share a band and outlive the sequential comparison, likeliest first; right None: pairs within left."""
    other = left if right is None else right
    n, m = len(left), len(other)
    kept, count = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 14) // max(1, m))
    for at in range(0, n, step):
        i, j = np.divmod(np.arange(min(step, n - at) * m), m)
        i = i + at
        if right is None:
            i, j = i[later := i < j], j[later]
        s = survivors(left[i], other[j], threshold, miss)
        equal = left[i[s]] == other[j[s]]
        banded = equal[:, : bands[0] * bands[1]].reshape(-1, *bands).all(axis=2).any(axis=1)
        kept.append(np.stack([i[s][banded], j[s][banded]], axis=1))
        count.append(equal[banded].sum(axis=1))
    order = np.argsort(-np.concatenate(count), kind="stable")
    return [(int(x), int(y)) for x, y in np.concatenate(kept)[order]]


def _compare(percent: tuple[int, int], miss: float, bands: tuple[int, int]):
    """Blocks (lists of doc_id, label, signature and text; `two` holds what `one` is compared with, or nothing) to links that join components."""
    num, den = percent
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels, signs, texts = [], [], [], []
                for c in (0, 1):
                    members = batch.column(c)[k].values
                    ids += members.field("doc_id").to_pylist()
                    labels += members.field("label").to_pylist()
                    signs.append(np.frombuffer(b"".join(members.field("signature").to_pylist()), np.uint8).reshape(-1, PLACES))
                    texts.append(members.field("text"))
                yield from _links(ids, labels, signs, pa.concat_arrays(texts))

    def _links(ids: list[int], labels: list[int], signs: list[np.ndarray], texts: pa.Array) -> Iterator[pa.RecordBatch]:
        pairs = _likely(signs[0], signs[1] if len(signs[1]) else None, num / den, miss, bands)
        if not pairs:
            return
        behind = len(signs[0]) if len(signs[1]) else 0
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        pairs = [(x, y + behind) for x, y in pairs]
        asked = sorted({p for pair in pairs for p in pair})
        quick = dict(zip(asked, (h for _, h, _ in hashed(texts.take(pa.array(asked)))), strict=True))
        whole: dict[int, set] = {}
        found: list[tuple[int, int]] = []
        for x, y in pairs:
            if ids[x] == ids[y] or top(labels[x]) == top(labels[y]):
                continue
            p, q = quick[x], quick[y]
            if den * min(len(p), len(q)) < num * max(len(p), len(q)):
                continue
            both = len(np.intersect1d(p, q, assume_unique=True))
            if den * both < num * (len(p) + len(q) - both):
                continue
            for z in (x, y):
                if z not in whole:
                    whole[z] = runs_of(words_of(texts[z].as_py()))
            both = len(whole[x] & whole[y])  # equal hashes aren't proof; equal words are
            if den * both >= num * (len(whole[x]) + len(whole[y]) - both):
                root[top(labels[x])] = top(labels[y])
                found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found]), pa.array([f[1] for f in found])], schema=schema)

    return run


def _pairs_left(percent: tuple[int, int], miss: float, bands: tuple[int, int]):
    """Blocks of a bucket (lists of doc_id, label, n_shingles, signature and sketch, as for links) to pairs of two labels that may be linked."""
    num, den = percent
    schema = pa.schema([(f"{c}_{side}", pa.int64()) for side in "ab" for c in ("doc_id", "label", "n_shingles")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _pairs(batch.column(0)[k].as_py(), [batch.column(c)[k].values for c in (1, 2)])

    def _pairs(bucket: int, sides: list[pa.StructArray]) -> Iterator[pa.RecordBatch]:
        signs = [np.frombuffer(b"".join(x.field("signature").to_pylist()), np.uint8).reshape(-1, PLACES) for x in sides]
        right = 1 if len(sides[1]) else 0
        i, j = np.array(_likely(signs[0], signs[1] if right else None, num / den, miss, bands), np.int64).reshape(-1, 2).T
        ids, labels, sizes = [[x.field(c).to_numpy() for x in (sides[0], sides[right])] for c in ("doc_id", "label", "n_shingles")]
        n, m = sizes[0][i], sizes[1][j]
        may = (labels[0][i] != labels[1][j]) & (den * np.minimum(n, m) >= num * np.maximum(n, m))
        i, j, both = i[may], j[may], (n + m)[may]
        if not len(i):
            return
        # a pair meets in each bucket that it shares, and is looked at in the first
        buckets = [buckets_of(x, bands, range(bands[0])) for x in (signs[0], signs[right])]
        first = np.concatenate([(buckets[0][i[at : at + 4096]] == buckets[1][j[at : at + 4096]]).argmax(axis=1) for at in range(0, len(i), 4096)])
        i, j, both = (x[first == bucket >> BAND_AT] for x in (i, j, both))
        sketches = [[(int.from_bytes(b, "little"), 8 * len(b)) for b in x.field("sketch").to_pylist()] for x in (sides[0], sides[right])]
        # den * intersection >= num * union, in terms of the sizes' sum and the runs that only one of both has
        may = [(den + num) * odd_places(sketches[0][x], sketches[1][y]) <= (den - num) * z for x, y, z in zip(i.tolist(), j.tolist(), both.tolist(), strict=True)]
        i, j = i[may], j[may]
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(c[side][at]) for side, at in ((0, i), (1, j)) for c in (ids, labels, sizes)], schema=schema)

    return run


def pairs_left(placed: DataFrame, chosen: DataFrame, percent: tuple[int, int], miss: float, bands: tuple[int, int]) -> DataFrame:
    """Members dealt to blocks of buckets to pairs that the signatures and sketches leave open; chosen: doc_id, signature, sketch."""
    member = F.struct("doc_id", "label", "n_shingles", "signature", "sketch")
    rows = placed.join(chosen.select("doc_id", "signature", "sketch"), "doc_id")
    one, two = F.collect_list(F.when(~F.col("second"), member)), F.collect_list(F.when(F.col("second"), member))
    blocks = rows.groupBy("bucket", "part", "with").agg(one.alias("one"), two.alias("two")).select("bucket", "one", "two")
    return blocks.mapInArrow(_pairs_left(percent, miss, bands), ", ".join(f"{c}_{side} long" for side in "ab" for c in ("doc_id", "label", "n_shingles")))


def _blocks(n: str, runs: str, times: int = 1) -> F.Column:
    """How many blocks so many members with so many word runs make."""
    return F.ceil(F.greatest(F.col(n) / (times * BLOCK), F.col(runs) / (times * BLOCK_RUNS), F.lit(1))).cast("int")


def _part(parts: str) -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.col(parts)).cast("int")


def links_of(placed: DataFrame, chosen: DataFrame, key: list[str], percent: tuple[int, int], miss: float, bands: tuple[int, int]) -> DataFrame:
    """Members dealt to blocks (key, doc_id, label, second) to links; chosen: doc_id, signature, text."""
    member = F.struct("doc_id", "label", "signature", "text")
    rows = placed.join(chosen.select("doc_id", "signature", "text"), "doc_id")
    one, two = F.collect_list(F.when(~F.col("second"), member)), F.collect_list(F.when(F.col("second"), member))
    blocks = rows.groupBy(*key).agg(one.alias("one"), two.alias("two")).select("one", "two")
    return blocks.mapInArrow(_compare(percent, miss, bands), "a long, b long")


def star_blocks(stars: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, star) to blocks of each star's members, its centre in all of them."""
    sizes = stars.groupBy("star").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("runs")).select("star", _blocks("n", "runs").alias("parts"))
    members = stars.join(sizes, "star").select("star", _part("parts").alias("part"), "doc_id")
    centres = sizes.select("star", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("star").alias("doc_id"))
    return members.union(centres).select("star", "part", "doc_id", F.col("doc_id").alias("label"), F.lit(False).alias("second"))


def open_members(labelled: DataFrame, bands: tuple[int, int]) -> DataFrame:
    """(doc_id, label, n_shingles, signature) to the members of the buckets that hold more than one label: bucket, doc_id, label, n_shingles.

    Of buckets with the same members only the first band's is left.
    """
    banded = stage(in_buckets(labelled.select("doc_id", "label", "n_shingles", "signature"), bands, slice(None)), "buckets")
    same = [F.bit_xor(F.xxhash64("doc_id", F.lit(k))) for k in (0, 1)]
    open_ = banded.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), *[s.alias(f"s{k}") for k, s in enumerate(same)], F.count(F.lit(1)).alias("n"))
    open_ = open_.filter("low <> high").groupBy("s0", "s1", "n").agg(F.min("bucket").alias("bucket")).select("bucket")
    return stage(banded.join(open_, "bucket"), "open-buckets")


def open_blocks(members: DataFrame, key: list[str], times: int = 1) -> DataFrame:
    """Members (key, doc_id, label, n_shingles) of groups of more than one label to blocks any two of which, of different labels, meet.

    home: the group's most frequent label. Others are compared with others (block `with` others) and with
    the home label's members (block `with` theirs, numbered from -1 down).
    """
    by_label = members.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("runs"))
    home = by_label.groupBy(*key).agg(F.max(F.struct("n", "label")).getField("label").alias("home"))
    mine = F.col("label") == F.col("home")
    parts = by_label.join(home, key).groupBy(*key).agg(
        F.max("home").alias("home"),
        F.count(F.lit(1)).alias("labels"),
        *[F.sum(F.when(own, F.col(c))).alias(f"{c}_{kind}") for kind, own in (("home", mine), ("other", ~mine)) for c in ("n", "runs")],
    )
    parts = parts.select(*key, "home", "labels", _blocks("n_home", "runs_home", times).alias("homes"), _blocks("n_other", "runs_other", times).alias("others"))
    dealt = members.join(parts, key).withColumn("part", F.when(mine, _part("homes")).otherwise(_part("others")))
    others = F.sequence(F.lit(0), F.col("others") - 1)
    # a block of home members meets each block of others; a block of others meets those, itself and each other one
    with_home = lambda o, h: F.struct(o.alias("part"), (-1 - h).alias("with"), mine.alias("second"))
    met_home = F.when(mine, F.transform(others, lambda o: with_home(o, F.col("part")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda h: with_home(F.col("part"), h)))
    met_other = F.transform(others, lambda o: F.struct(F.least(o, F.col("part")).alias("part"), F.greatest(o, F.col("part")).alias("with"), (F.col("part") > o).alias("second")))
    met = F.when(mine | (F.col("labels") == 2), met_home).otherwise(F.concat(met_home, met_other))  # others of one label are one component
    rows = dealt.select(*key, "doc_id", "label", "n_shingles", F.explode(met).alias("at"))
    return rows.select(*key, "at.*", "doc_id", "label", "n_shingles")


def between_labels(pairs: DataFrame) -> DataFrame:
    """Pairs left to the documents they name, once for each two labels: low, high, doc_id, label, n_shingles."""
    low, high = F.least("label_a", "label_b").alias("low"), F.greatest("label_a", "label_b").alias("high")
    sides = [pairs.select(low, high, *[F.col(f"{c}_{side}").alias(c) for c in ("doc_id", "label", "n_shingles")]) for side in "ab"]
    return stage(sides[0].union(sides[1]).distinct(), "open-documents")


def candidates(reps: DataFrame, bands: tuple[int, int]) -> DataFrame:
    """(doc_id, star) of the representatives that share a bucket: the least one that they share one with, or (the centre of its buckets) null.

    The first EARLY bands find most; of the others only representatives that those leave alone take part, so what is
    joined stays in proportion to the members of a large group, not to them times all bands.
    """
    plain = reps.select("doc_id", "signature")
    ends = in_buckets(plain, bands, slice(None)).groupBy("bucket").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    ends = stage(ends.filter("first <> last").select("bucket", "first"), "shared-buckets")

    def found(rows: DataFrame, which: slice) -> DataFrame:
        met = in_buckets(rows, bands, which).join(ends, "bucket")
        return met.groupBy("doc_id").agg(F.min("first").alias("first"))

    early = stage(found(plain, slice(0, EARLY)), "early-candidates")
    late = found(plain.join(early, "doc_id", "left_anti"), slice(EARLY, None))
    return early.union(late).select("doc_id", F.when(F.col("first") < F.col("doc_id"), F.col("first")).alias("star"))


def linked_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: tuple[int, int] = THRESHOLD, miss: float = MISS, bands: tuple[int, int] = (BANDS, ROWS)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    component_id is the least doc_id reachable over links (percent[1] * intersection >=
    percent[0] * union of sets), the document's own included; kept if it is the doc_id.
    Null and empty texts, and texts without words, have an empty set and no link: they are
    their own component. Rows that repeat a doc_id with other words share its links; rows with a
    null doc_id are kept, link nothing and have a null component. An empty table gives no rows.
    bands: how many and of how many places, at most PLACES together.
    """
    described = stage(describe(docs, id_col, text_col), "signatures")
    # the least doc_id stands for all documents with its sequence of words
    owners = described.filter("words_hash is not null and doc_id is not null").groupBy("words_hash")
    owners = stage(owners.agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")), "representatives")
    # of a repeated doc_id with several sequences of words, which of them stands for it depends on the words alone
    reps = owners.select(F.col("rep").alias("doc_id"), "n_shingles", "words_hash", "signature")
    texts = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))

    shared = stage(candidates(reps, bands), "candidates")
    chosen = stage(_with_texts(shared, reps, texts), "candidate-texts")
    stars = chosen.filter("star is not null").select("doc_id", "n_shingles", "star")
    links = stage(links_of(star_blocks(stars), chosen, ["star", "part"], percent, miss, bands), "star-links")
    label = components(links).withColumnRenamed("group", "label")
    labelled = chosen.join(label, "doc_id", "left").select("doc_id", F.coalesce("label", "doc_id").alias("label"), "n_shingles", "signature")
    wide = open_blocks(open_members(labelled, bands), ["bucket"], WIDER)
    asked = open_blocks(between_labels(pairs_left(wide, chosen, percent, miss, bands)), ["low", "high"])
    more = stage(links_of(asked, chosen, ["low", "high", "part", "with"], percent, miss, bands), "open-links")
    groups = components(links.union(more))
    rows = described.select("doc_id", "n_shingles", "words_hash").join(owners.select("words_hash", "rep"), "words_hash", "left")
    out = rows.join(groups.select(F.col("doc_id").alias("rep"), "group"), "rep", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("group", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def _with_texts(shared: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates with what they are compared by: doc_id, star, n_shingles, signature, text, sketch.

    A row of texts that repeats a doc_id with other words than the representative's isn't meant; one with the same words, whatever its case and spaces, stands for all.
    """
    described = shared.join(reps, "doc_id")

    def meant(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, some in in_portions(batch.column(1)):
                keys, sketches = zip(*[(key, odd_sketch(hashes)) for _, hashes, key in hashed(some)], strict=True)
                part = batch.slice(first, len(some))
                own = part.select([0, 1, 3, 4, 5]).append_column("sketch", pa.array(sketches, pa.binary()))
                yield own.filter(pc.equal(pa.array(keys, pa.binary()), part.column(2)))

    rows = texts.join(described, "doc_id").select("doc_id", "text", "words_hash", "star", "n_shingles", "signature")
    once = rows.mapInArrow(meant, "doc_id long, text string, star long, n_shingles long, signature binary, sketch binary")
    return once.groupBy("doc_id", "signature").agg(*[F.min(c).alias(c) for c in ("star", "n_shingles", "text", "sketch")])


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows without those whose near-duplicate group keeps another document; of repeated rows of a doc_id one.

    Rows with a null doc_id are kept. Documents are linked from STAGE_THRESHOLD on.
    """
    gone = linked_groups(docs, percent=STAGE_THRESHOLD, bands=STAGE_BANDS).filter("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_anti")
    repeated = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.select(*docs.columns).unionByName(repeated.select(*docs.columns))
