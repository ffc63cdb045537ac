"""Conversation repair, spelling variants and piece encoding against brute force and the library."""

import collections
import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from sentencepiece import SentencePieceProcessor

from firmscope.llm import pieces, repair, spelling
from firmscope.llm.common import tokenizer_path

BLANK = re.compile("[^\x20\x09-\x0d]")


# ---------------------------------------------------------------- conversations


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """All edits tried, with memory, as whole strings; rows: (role, text, fault)."""

    @lru_cache(None)
    def best(i, state, behind):
        ways = []
        if i == len(rows):
            if state in (0, 3):
                ways.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            extra = fault == "truncated"

            def go(cost, letter, to, line):
                if to is not None and (rest := best(i + 1, to, 0)):
                    ways.append((cost + rest[0], letter + rest[1], line + rest[2]))

            go(3, "D", state, ())
            if fault not in ("blank", "duplicate"):
                step = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
                go(extra, "K", step.get((role[:1], state)), (f"{role}:{text}",))
                for who in ("user", "assistant"):
                    go(2 + extra, "R", step.get((who[0], state)), (f"{who}:{text}",))
        if behind < 3:
            who, to = ("assistant", 3) if state == 2 else ("user", 2)
            if rest := best(i, to, behind + 1):
                ways.append((2 + rest[0], "I" + rest[1], (f"{who}:",) + rest[2]))
        return min(ways) if ways else None

    return best(0, 0, 0)


def repaired(rows):
    convs = {r[0]: [] for r in rows}
    for r in damaged(rows):
        convs[r[0]].append(r[1:])
    out = {}
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, count = set(), [], collections.Counter()
        for _, role, text in some:
            said = BLANK.findall(text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in some if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        cost, audit, lines = cheapest(tuple(marked))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_conversations(n, longest, seed):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", None, "agent"])
            rows.append((conv, turn if rng.random() < 0.9 else turn + 3, role, rng.choice(["Yes.", "No!", "cut", "", " \t", None, "Why? ", "a\nb.", "x" * rng.choice([1, 5000]) + "."])))
    return [*rows, (None, 1, "user", "Hi."), (None, None, "assistant", "Yo."), (5000, None, "user", "."), (5001, None, None, None)]


SCHEMA = "conv_id long, turn long, role string, text string"
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("block_rows", [3, 1024])
def test_repair_equals_all_ways(spark, block_rows):
    rows = random_conversations(150, 14, 7)
    got = {r["conv_id"]: tuple(r[c] for c in RESULT) for r in repair.repair_report(spark.createDataFrame(rows, SCHEMA).repartition(3), block_rows).collect()}
    assert got == repaired(rows)


def test_repair_of_long_conversations_and_none(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two", f"{t}."])) for t in range(300)]
    got = {r["conv_id"]: tuple(r[c] for c in RESULT) for r in repair.repair_report(spark.createDataFrame(rows, SCHEMA), 16).collect()}
    assert got == repaired(rows)
    assert repair.repair_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_grammar_changes_nothing():
    rng = random.Random(5)
    rules = [("ua", "一"), ("一一", "丁"), ("-u", "丂")]
    plain, short = repair.Evaluator([]), repair.Evaluator(rules)
    for _ in range(200):
        s = "".join(rng.choices(repair.SYMBOLS, k=rng.randint(1, 30)))
        assert plain.entries(s) == short.entries(s)


def test_rules_are_frequent_pairs(spark):
    blocks = spark.createDataFrame([("uauaua",)] * 5 + [("suaua",)] * 3 + [("xxxxx",), ("-",)], "symbols string")
    rules = dict(repair.learn_rules(blocks))
    assert "ua" in rules and len(rules) > 2


# ---------------------------------------------------------------- spelling


def variants(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= 5}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    rows = {}
    for w in n:
        close = [v for v in n if near(w, v)]
        top = min(close, key=lambda v: (-n[v], v), default=None)
        form = top if top and n[top] >= 5 * n[w] else None
        rows[w] = (form, n[w], len(close), n[form] if form else None)

    def root(w):
        return root(rows[w][0]) if rows[w][0] else w

    return {w: (f, root(w), c, k, m) for w, (f, c, k, m) in rows.items()}


def spelled_corpus():
    rng = random.Random(11)
    letters = "abcdeéÉß"
    base = ["".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(12)]
    words = {}
    for b in base:
        words[b] = 150
        for _ in range(12):
            i = rng.randrange(len(b))
            v = rng.choice([b[:i] + b[i + 1 :], b[:i] + rng.choice(letters) + b[i + 1 :], b[:i] + rng.choice(letters) + b[i:]])
            words[v] = rng.choice([4, 5, 6, 25, 30])
            j = rng.randrange(len(v))
            words[v[:j] + rng.choice(letters) + v[j + 1 :]] = 5
    bag = [w for w, c in words.items() for _ in range(c)]
    rng.shuffle(bag)
    rows = [(i, " ".join(w if rng.random() < 0.8 else w.capitalize() for w in bag[i::40]) + ", ") for i in range(40)]
    return [*rows, rows[0], rows[0], (None, rows[1][1]), (77, None), (78, ""), (79, "x1y2 ..."), (80, "longest" * 5000)]


def test_variants_equal_brute_force(spark):
    rows = spelled_corpus()
    got = spelling.variant_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = variants(rows)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want and len(got) == len(want)
    assert sum(r["root"] not in (r["word"], r["form"]) for r in got) > 0  # chains of forms are met
    assert spelling.variant_report(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_near_pair_is_missed(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abc", k=rng.choice([6, 6, 7]))) for _ in range(700)}
    got = spelling.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).select("a", "b").collect()
    wild = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            wild[w[:i] + "*" + w[i + 1 :]].add(w)
            wild["-" + w[:i] + w[i + 1 :]].add(w)
    pairs = {(a, b) for k, g in wild.items() if k[0] != "-" for a in g for b in g if a < b}
    pairs |= {tuple(sorted((w[1:], x))) for w, g in wild.items() if w[0] == "-" and w[1:] in words for x in g}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == pairs


def test_no_table_of_words_is_broadcast(spark, capsys, monkeypatch):
    """Spark sizes a join's tables by their files, and words with all their keys, or with a root, are far larger than those."""

    def plan(df):
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    def noted(df, name):
        plans.append((name, plan(df)))
        return stage(df, name)

    plans, stage = [], spelling.stage
    monkeypatch.setattr(spelling, "stage", noted)
    report = spelling.variant_report(spark.createDataFrame(spelled_corpus(), "doc_id long, text string"))
    words = stage(spark.createDataFrame([("abcdef", 5), ("abcdeg", 6)], "word string, n long"), "spelling-words")
    joins = [p for name, p in plans if name == "spelling-roots"][1:] + [plan(report), plan(spelling.near_pairs(words))]
    assert len(joins) > 3 and all("SortMergeJoin" in p and "Broadcast" not in p for p in joins)


# ---------------------------------------------------------------- pieces

MODEL = "piece_bpe_32k.model"


def odd_texts():
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "▁", "é", "a", "word", "The", "<s>", "<unk>", "<0x0A>", "</s>", "\0", "日本", "🙂", " ", "é", ".", "12", " ", " " * 40, "x" * 50]
    return [None, "", " ", "  ", "▁", " a", "a ", "▁a", "a▁", *["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(600)], "word " * 40_000, "y" * 30_000]


def test_pieces_equal_the_library(spark):
    library = SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    texts = odd_texts()
    rows = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, PIECE_ids string")
    coded = pieces.encode_pieces(rows, MODEL)
    name = coded.columns[-1]
    got = pieces.decode_pieces(coded, MODEL, ids_col=name).collect()
    for r in got:
        want = library.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r[name] == want and r["decoded"] == library.decode(want) and r["PIECE_ids"] == "own"
    assert len(got) == len(texts)


def test_table_forgets_and_still_agrees():
    library = SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    table = pieces.ChunkTable(tokenizer_path(MODEL), most=50, longest=6)
    texts = [t or "" for t in odd_texts()[:300]]
    for i in range(0, 300, 20):
        assert table.encode(texts[i : i + 20]).to_pylist() == [library.encode(t, add_eos=True) for t in texts[i : i + 20]]
    assert len(table.known) + len(table.older) <= 300


def test_piece_digests(spark):
    library = SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    texts = [None, "", "Zwei Wörter.", "Zwei Wörter."]
    got = sorted(map(tuple, pieces.piece_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert got == want
    assert pieces.piece_digests(spark.createDataFrame([], "doc_id long, text string"), MODEL).collect() == []
