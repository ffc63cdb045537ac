"""Token files, packing, mixing and sharding against brute force."""

import collections
import math
import random
from fractions import Fraction
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmscope.llm import mixing, packing, sharding, tokens
from firmscope.llm.common import rank_in_group, stage, tokenizer_path

ODD = ["", " ", "a  b", " a b ", "x\n y  \n\n z", "don't  stop\tnow   b", "<|endoftext|> x", "é́ a", "İX \x1c y", "a\x85 b", "日本 語 テスト", "\x01 a\x01b c", "a.\nb,\nc", "\n", "A.B. c.,. ,", "w" * 90 + " " + "v" * 90]

FRAGMENTS = ["İ", "İ.", "ǅ,", "ΑΣ.", "É", "é.", "क़.", "a", "B", "it's", "'LL", "\n", "\n\n", " ", "  ", "\t", "\u3000", "\0", "\1", "<|endoftext|>", "<|startoftext|>", "12", "3.5,", "...", "don't.", "\r\n", "中文", "\u0301", "ß.", "ſ", "😀", "_", "a_b.", "\x85", "\xa0", " .", ". ", "ﬁ.", "Å,"]


@pytest.mark.parametrize(("file", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("special", [False, True])
def test_pieces_encode_as_whole_texts(spark, sf, file, spaced, special):
    """Table texts, texts of odd fragments, and every letter (but for CJK and Hangul) before a full stop and a comma."""
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    r = random.Random(5)
    texts += ["".join(r.choices(FRAGMENTS, k=r.randint(0, 14))) for _ in range(3000)]
    letters = [chr(c) for c in range(0x20000) if unicodedata.category(chr(c))[0] == "L" and not (0x3400 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or 0x17000 <= c <= 0x18FFF)]
    texts += [f"a {c}. x{c}, {c}y {c}" for c in letters]
    plain = Tokenizer.from_file(tokenizer_path(file))
    plain.encode_special_tokens = not special  # a plain call gives special strings their own ids
    small = tokens.Encoder(tokenizer_path(file), spaced, most=500, special=special)  # the cache overflows
    for first, some in tokens.in_portions(pa.array(texts), 20_000):
        ids, ends = small.encode(some)
        assert len(ids) == ends[-1]
        for t, a, b in zip(texts[first:], [0, *ends[:-1]], ends, strict=False):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t
    ids, ends = small.encode(pa.array([], pa.string()))
    assert len(ids) == len(ends) == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_elias_fano(n):
    ends = np.cumsum(np.random.default_rng(n).integers(0, 900, n))
    code = tokens.ef_encode(ends)
    r = tokens.BoundReader(code)
    assert [r.select(i) for i in range(n)] == ends.tolist() and r.all().tolist() == ends.tolist()
    if n == 1000:
        assert len(code) < n * 14 // 8
    with pytest.raises(IndexError):
        r.select(n)


def test_token_files(spark):
    rows = [(5, "b c"), (2, None), (9, "x " * 400), (2, "a"), (None, "z"), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "t x.y")
    got = tokens.read_token_blocks(tokens.write_token_blocks(df, "byte_bpe_50k.json", True, 0, text_col="t x.y", block_ids=100)).orderBy("start").collect()
    plain, at = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokens.read_token_blocks(tokens.write_token_blocks(df.limit(0), "byte_bpe_50k.json", True, 0, text_col="t x.y")).count() == 0


def naive(lengths, window):
    open_ = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(open_) if c >= n]
        if fits:
            open_[min(fits)[1]] -= n
        else:
            open_.append(window - n)
    return sorted(open_)


def test_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(150):
        window = r.choice([8, 64, 100])
        lengths = [r.randint(1, window) for _ in range(r.randint(0, 150))]
        used, got = collections.Counter(), collections.Counter()
        for n, _, many, first, each, _ in packing.best_fit_plan(collections.Counter(lengths), window):
            got[n] += many
            for j in range(many):
                used[first + j // each] += n
        assert got == collections.Counter(lengths) and sorted(window - v for v in used.values()) == naive(lengths, window)


def test_packs(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, "word " * 5000), (None, "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.length for r in got) == 4 + 4 + 1 + 1 + 5001 + 2
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    assert sorted(by) == list(range(len(by)))
    for some in by.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_hold_the_librarys_ids(spark, sf):
    """Start, length, checksum and total of every piece, over whole texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("doc_id is not null")
    plain, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), {}
    plain.encode_special_tokens = True
    for r in docs.collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [1]
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4")
            want[r.doc_id, at] = (len(part), zlib.crc32(part.tobytes()), len(ids))
    got = packing.pack_documents(docs).collect()
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32, r.doc_tokens) for r in got} == want and len(got) == len(want)


def test_ranks(spark):
    rows = [(g, r, k) for k, (g, r) in enumerate([("a", 5), ("a", None), ("a", 5), ("b", 1 << 60), ("a", -7), (None, 3), (None, 1)])]
    got = rank_in_group(spark.createDataFrame(rows, "g string, r long, k long"), ["g"], "r", ["k"], "n").collect()
    assert {x.k: x.n for x in got} == {1: 0, 4: 1, 0: 2, 2: 3, 3: 0, 6: 0, 5: 1}


def test_ranks_of_ids_all_over_the_range(spark):
    """Hashed ids over the signed range, and one outlier far from the others."""
    r = random.Random(2)
    for ids in ([r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(400)] + [-(1 << 63), (1 << 63) - 1], [*range(400), 1 << 62]):
        rows = [(i % 2, d) for i, d in enumerate(ids)]
        df = spark.createDataFrame(rows, "g long, id long")
        got = {(x.g, x.id): x.n for x in rank_in_group(df, ["g"], "id", ["id"], "n").collect()}
        assert got == {(g, d): n for g in (0, 1) for n, d in enumerate(sorted(d for k, d in rows if k == g))}
        docs = df.select(F.col("id").alias("doc_id"), F.col("g").cast("string").alias("source"), F.lit("a b").alias("text"))
        assert mixing.mix_sources(docs).count() == packing.pack_documents(docs).count() == len(rows)


def deviation(run, weights):
    """The most that any source is off its weight over all prefixes up to the first run-out, in blocks, exactly."""
    total, had, left, worst = sum(map(Fraction, weights.values())), collections.Counter(), collections.Counter(run), 0
    for i, s in enumerate(run, 1):
        had[s] += 1
        if had[s] > left[s] - 1:
            return i, worst
        worst = max(worst, max(abs(had[k] - i * Fraction(w) / total) for k, w in weights.items()))
    return len(run), worst


def plain_edf(units, blocks):
    """Slot by slot over all slots, in whole numbers; units in the order that breaks ties."""
    total, had, run, slot = sum(units.values()), dict.fromkeys(units, 0), {}, 0
    while any(had[s] < blocks[s] for s in units):
        ready = [(-(-(had[s] + 1) * total // u), i, s) for i, (s, u) in enumerate(units.items()) if had[s] * total // u <= slot]
        s = min(ready)[2]
        if had[s] < blocks[s]:
            run[slot] = s
        had[s] += 1
        slot += 1
    return run


def scheduled(spark, weights, blocks, stretch):
    sources = spark.createDataFrame([(s, float(w), blocks[s]) for s, w in weights.items()], "source string, weight double, blocks long")
    units = stage(mixing.source_units(sources), "units")
    one = units.first()
    many = max(math.ceil(x["blocks"] * one["total"] / x["u"]) for x in one["s"]) // stretch + 1
    return one, {r.slot: (r.source, r.block) for r in mixing.schedule(units, many, stretch).collect()}


MIXES = {
    "whole": {"a": 5, "b": 1, "c": 3, None: 2},
    "roots": {f"s{i}": math.sqrt(i * i * i + 1) for i in range(23)},
    "steep": {"big": 1000.5, "mid": 30.25, **{f"t{i}": 0.4 + i / 7 for i in range(9)}},
    "even": {f"e{i}": 1.1 for i in range(12)},
}


@pytest.mark.parametrize("name", MIXES)
@pytest.mark.parametrize("stretch", [7, 64, 1024])
def test_schedule_holds_the_true_weights(spark, name, stretch):
    """Less than one block off the weights as given, not as rounded, at every prefix; blocks of a source follow each other."""
    weights = MIXES[name]
    total = sum(weights.values())
    blocks = {s: max(1, round(1500 * w / total)) for s, w in weights.items()}
    one, slots = scheduled(spark, weights, blocks, stretch)
    run = [slots[i][0] for i in sorted(slots)]
    until, worst = deviation(run, weights)
    assert sorted(slots)[:until] == list(range(until)) and until > 500 * (name != "steep") and worst < 1
    assert collections.Counter(run) == blocks
    for s in weights:
        assert [slots[i][1] for i in sorted(slots) if slots[i][0] == s] == list(range(blocks[s]))
    if stretch == 1024 and name != "steep":  # far from a stretch's end nothing tells it from one long run
        plain = plain_edf({x["source"]: x["u"] for x in one["s"]}, blocks)
        assert [slots[i][0] for i in range(500)] == [plain[i] for i in range(500)]


def test_long_schedules_do_not_drift(spark):
    """Far out, each stretch still begins and ends less than one block off: no error adds up."""
    weights = {f"s{i}": math.sqrt(3 + 7 * i) for i in range(17)}
    sources = spark.createDataFrame([(s, w, 1 << 40) for s, w in weights.items()], "source string, weight double, blocks long")
    starts = mixing.stretch_starts(stage(mixing.source_units(sources), "units"), 3, 1 << 28).orderBy("k").collect()
    total = sum(weights.values())
    for r in starts:
        had = {x["source"]: y["base"] + y["ahead"] for x, y in zip(r["s"], r["at"], strict=True)}
        slot = r["k"] << 28
        assert sum(had.values()) == slot and all(abs(had[s] - slot * w / total) < 1 for s, w in weights.items())


def test_mix_keeps_every_row(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "x") for i in range(200)] + [(5, "s1", "again"), (None, "s1", "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, x string").withColumnRenamed("x", "mix.p_units")
    got = mixing.mix_sources(df, block_rows=4, stretch=64).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.source, r["mix.p_units"]) for r in got} == set(rows)
    slots = collections.defaultdict(set)
    for r in got:
        slots[r.mix_slot].add(r.source)
    assert all(len(s) == 1 for s in slots.values())
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_thousands_of_sources(spark):
    """All rows, one slot a block, and still less than one block off."""
    rows = [(i, f"s{i % 5000}") for i in range(7000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=1, power=1.0).collect()
    assert {(r.doc_id, r.source) for r in got} == set(rows) and len({r.mix_slot for r in got}) == len(rows)
    counts = collections.Counter(s for _, s in rows)
    run = [r.source for r in sorted(got, key=lambda r: r.mix_slot)]
    had = collections.Counter()
    for i, s in enumerate(run, 1):
        had[s] += 1
        assert abs(had[s] - i * counts[s] / 7000) < 1


def test_shards(spark):
    rows = [(i, "same text here" if i % 3 == 0 else f"text {i} " * (1 + i % 9), "x") for i in range(600)] + [(None, None, "x"), (7, "", "x"), (7, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").withColumns({c: F.lit(1) for c in ("l_key", "shard_p_item", "shard_c_0", "before", "S_item", "n")})
    got = sharding.assign_shards(stage(sharding.measure(df), "m"), shards=4).collect()
    assert len(got) == len(rows)
    size, slot, of = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        assert r.shard_size == len((r.text or "").encode()) + 1 and r.shard_text_crc32 == zlib.crc32((r.text or "").encode())
        size[r.shard] += r.shard_size
        slot[r.shard].append(r.shard_slot)
        of[r.text or ""].add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in slot.values())
    assert all(len(v) == 1 for t, v in of.items() if t != "same text here")
    assert max(size.values()) < 1.1 * min(size.values())
    assert sharding.assign_shards(stage(sharding.measure(df.limit(0)), "m")).count() == 0


def test_placing_prefers_the_largest_dot_product():
    assert sharding.place_by_dot_product([(4, 4, 4), (3, 3, 3), (2, 2, 2), (1, 1, 1)], 2) == [0, 1, 1, 0]
    assert sharding.place_by_dot_product([], 2) == []
