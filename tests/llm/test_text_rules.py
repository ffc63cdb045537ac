"""Quality, license, language and near-duplicate operators against brute force and edge cases."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmscope.llm import langid, licenses, neardup, quality
from firmscope.llm.common import stage

SCHEMA = "doc_id long, text string, lang string, source string, extra string"


def brute_statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics_and_verdicts(spark, sf):
    r = random.Random(5)
    texts = [None, "", " ", "a\nb\na\n\n \n a", "x " * 30, " ".join(f"w{i}" for i in range(300)), "a b c d e f g h " * 2 + "z", "é ü\x0b#*$ <b>"]
    texts += [" ".join(r.choice("ab") for _ in range(r.randint(0, 40))) for _ in range(60)]
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "s", "x") for i, t in enumerate(texts)] + [(1, "", "en", "s", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("extra", "quality")
    for got in quality.quality_report(df).collect():
        text = {i if i != 3 else None: t for i, t in enumerate(texts)}[got.doc_id]
        want = brute_statistics(text)
        assert tuple(got)[1:6] == want
        assert got.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert got.kept == (not got.base_failed)  # too few rows to estimate from
    assert sorted(quality.keep_good(df).columns) == sorted(df.columns)
    assert quality.quality_report(df.limit(0)).count() == 0


def test_outliers_go_and_clean_texts_stay(spark):
    r = random.Random(7)
    clean = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(30, 400))) for _ in range(500)]
    odd = [" ".join(x + "***" for x in t.split()) for t in clean[:25]]
    rows = [(i, t, "en", "s1" if i % 3 else "s2", None) for i, t in enumerate(clean + odd)]
    got = {x.doc_id: x.kept for x in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(500)) and not any(got[i] for i in range(500, 525))


def test_each_statistic_rejects_by_itself(spark):
    """One odd text for each statistic, each below the base rule; a line printed at both ends of a text is not odd."""
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 8)))
    prose = lambda n: [word() for _ in range(n)]
    lines = lambda n: [" ".join(prose(r.randint(6, 12))) for _ in range(n)]
    clean = ["\n".join(lines(r.randint(4, 40))) for _ in range(400)]
    framed = ["\n".join([head, *lines(10), head]) for head in (" ".join(prose(12)) for _ in range(20))]
    body = prose(600)
    odd = {
        "word_chars": " ".join(w * 3 for w in prose(200)),
        "symbols": " ".join(w + "#" for w in prose(200)),
        "dup_lines": "\n".join(x for _ in range(60) for x in ("so", " ".join(prose(8)))),
        "repeats": " ".join([*body, *body[:98]]),
    }
    rows = [(i, t, "en", "s", None) for i, t in enumerate([*clean, *framed, *odd.values()])]
    got = {x.doc_id: x for x in quality.quality_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].kept for i in range(420))
    assert [k for i, k in enumerate(odd, 420) if got[i].kept or got[i].base_failed] == []


def test_mcd_resists_a_minority(spark):
    """Centre and factor come from the tight majority, not from a fifth of far rows."""
    r = random.Random(9)
    rows = [(1, [int(r.gauss(1500, 50)), int(abs(r.gauss(20, 9))), 0, 0]) for _ in range(800)] + [(1, [3000, 900, 700, 800])] * 200
    fit = quality.fit_mcd(spark.createDataFrame(rows, "one int, x array<long>"), ["one"]).first()
    assert abs(fit.c0 - 1500) < 15 and fit.c1 < 40 and fit.c2 == 0


def model_mcd(vectors, support=0.75, steps=3):
    """Centre and covariance of whole vectors, in numpy: tightest share by distances cut at histogram bins."""
    x = np.array(vectors, float)
    floor = np.array(quality.FLOOR) * quality.SCALE
    bins = np.floor(x / 10)
    centre = np.array([np.sort(bins[:, i])[-(-len(x) // 2) - 1] * 10 + 5 for i in range(x.shape[1])])
    inverse = np.diag(1 / floor**2)
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
        bin_of = np.floor(np.log1p(d) * 64)
        need, run = int(np.ceil(len(x) * support)), 0
        for b in np.unique(bin_of):
            upto = b
            run += (bin_of == b).sum()
            if run >= need:
                break
        own = x[bin_of <= upto]
        centre = own.mean(axis=0)
        cov = (own.T @ own / len(own) - np.outer(centre, centre)) / support**1.6 + np.diag(floor**2)
        inverse = np.linalg.inv(cov)
    return centre, inverse


def test_verdicts_against_a_model(spark):
    """Every kept of three levels of groups, against estimates in numpy over the same whole statistics."""
    r = random.Random(8)

    def text(kind):
        words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(r.randint(25, 120))]
        if kind == "symbols":
            words = [w + r.choice("#*$%|") * r.randint(0, 9) for w in words]
        if kind == "lines":
            return "\n".join(["same"] * r.randint(5, 60) + [" ".join(words)])
        return " ".join(w * 6 if kind == "long" else w for w in words)

    rows = []
    for i in range(900):
        lang, source = ("en", "big") if i < 400 else ("en", f"small{i % 5}") if i < 600 else ("de" if i % 2 else None, f"s{i % 9}")
        kind = r.choice(["symbols", "lines", "long"]) if r.random() < 0.06 else "plain"
        rows.append((i, text(kind), lang, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    measured, name = quality.with_statistics(docs)
    staged = stage(measured, "test-statistics")
    got = {x.doc_id: x.kept for x in quality.judge(staged, name, least=120).collect()}
    data = [(x.doc_id, x.lang, x.source, x[name]["x"], x[name]["base_failed"]) for x in staged.collect()]
    groups = collections.defaultdict(list)
    for _, lang, source, x, failed in data:
        if not failed:
            for key in ((0, lang, source), (1, lang, None), (2, None, None)):
                groups[key].append(x)
    fits = {k: model_mcd(v) for k, v in groups.items() if len(v) >= 120}
    assert {k[0] for k in fits} == {0, 1, 2} and (1, None, None) in fits
    near = want = 0
    for d, lang, source, x, failed in data:
        centre, inverse = next(fits[k] for k in ((0, lang, source), (1, lang, None), (2, None, None)) if k in fits)
        z = np.array(x, float) - centre
        distance = z @ inverse @ z
        if abs(distance - quality.CUTOFF) < 1e-6 * quality.CUTOFF:
            near += 1  # a tie of rounding
            continue
        want += not (not failed and distance <= quality.CUTOFF)
        assert got[d] == (not failed and distance <= quality.CUTOFF), (d, distance)
    assert near < 3 and want > 10


RULES = licenses.rules()


def brute_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    line = "".join(f" {x} " for x in w)
    hits = sorted({(m.start(), -m.end(), r.rank, r.label) for r in RULES if f" {r.keyword} " in line for m in re.finditer(licenses.compile_pattern(r.pattern), line)})
    kept = [h for i, h in enumerate(hits) if h[2] == 0 or not any(g[1] <= h[1] and g[2] <= h[2] for g in hits[:i])]
    base = [(i, label) for label, _, p in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    best = min((h[2] for h in kept), default=None)
    return (len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({b for _, b in base})), ",".join(sorted({h[3] for h in kept})), 0.0 if best is None else licenses.CONFIDENCE[best])


def test_licenses(spark):
    texts = [None, "", "...", "CC by NC cc by nc cc-by-nc under the MIT license Under THE mit LICENSE apache license version 2", "SPDX-License-Identifier: GPL-3.0-or-later",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This work is licensed under CC BY-NC-SA 4.0. É mit license", "cc0", "permit licenses", "BSD 2-Clause"]
    texts += [f"x {r.pattern} y" for r in RULES if re.fullmatch(r"[\w ]+", r.pattern)]
    texts.append("under the mit license. " * 300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for got in licenses.license_report(df).collect():
        assert tuple(got)[1:] == brute_licenses(texts[got.doc_id]), texts[got.doc_id]
    assert licenses.license_report(df.limit(0)).count() == 0


def test_a_text_of_very_many_detections(spark):
    n = 30_000
    rows = [(1, "Under the MIT license. " * n), (2, "under the apache license version 2 or gplv3, " * n)]
    got = {r.doc_id: r for r in licenses.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert tuple(got[1])[1:] == (4 * n, n, 0, 4 * (n - 1), "mit", "mit", 1.0)
    assert tuple(got[2])[1:6] == (8 * n, n, 2, 8 * (n - 1) + 2, "apache-2") and "apache-2" in got[2].labels and "gpl-3" in got[2].labels


def example(pattern):
    """A text that the word pattern matches: first choices, no optional parts."""
    while "(" in pattern:
        pattern = re.sub(r"\(([^()]*)\)(\??)", lambda m: "" if m[2] else m[1].split("|")[0], pattern, count=1)
    return " ".join(re.sub(r"\[(\d)\d*\]", r"\1", pattern.split("|")[0]).replace("*", "word").split())


@pytest.mark.parametrize("rule", RULES[::9], ids=lambda r: f"{r.label}-{r.rank}")
def test_every_rule_matches_and_passes_the_gate(rule):
    text = example(rule.pattern)
    line = "".join(f" {w} " for w in text.split())
    assert re.search(licenses.compile_pattern(rule.pattern), line), text
    assert any(g in text for g in licenses.GATE) or re.search(r"\bcc by", text)


def test_all_rules_gate():
    assert len(RULES) > 400
    for rule in RULES:
        text = example(rule.pattern)
        assert any(g in text for g in licenses.GATE) or re.search(r"\bcc by", text), rule


def alternatives(names):
    """The choices outside of parentheses."""
    out, depth = [""], 0
    for c in names:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "|" and not depth else [*out[:-1], out[-1] + c]
    return out


def test_every_alternative_through_the_detector(spark):
    """Against a brute force without keywords: the name, the grant and the identifier of each alternative."""
    plain = lambda p: example(licenses._spaced(p))
    texts = []
    for _, _, names, ids in licenses.NAMES:
        for alternative in alternatives(names):
            texts += [f"x {plain(alternative)} y", f"Licensed under the {plain(alternative).upper()}.", f"governed by {plain(alternative)}"]
        texts += [f"SPDX-License-Identifier: {plain(i)}" for i in alternatives(ids)]
    texts += [f"x {example(p)} y" for _, _, p in licenses.BASE] + [f"x {example(p.replace('(' + chr(92) + 'w+ )?', '(*)?'))} y" for _, _, p in licenses.NOTICES]
    distinct = {(r.label, r.rank, licenses.compile_pattern(r.pattern)) for r in RULES}
    for got in licenses.license_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        line = "".join(f" {x} " for x in re.findall(r"[a-z0-9]+", texts[got.doc_id].lower()))
        hits = sorted({(m.start(), -m.end(), rank, label) for label, rank, p in distinct for m in re.finditer(p, line)})
        kept = [h for i, h in enumerate(hits) if h[2] == 0 or not any(g[1] <= h[1] and g[2] <= h[2] for g in hits[:i])]
        assert hits and got.labels == ",".join(sorted({h[3] for h in kept})) and got.score == licenses.CONFIDENCE[min(h[2] for h in kept)], texts[got.doc_id]


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.language_report(docs.withColumn("lang_score", F.lit("clash"))).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "½ 12 ...", None), (None, "the", None), (4, "the " * 300_000, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, langid.fit(docs)).collect()}
    assert got == {1: "und", 2: "und", 3: "und", None: "en", 4: "en"}
    assert langid.language_report(odd.limit(0)).count() == 0
    assert {r.doc_id for r in langid.keep_identified(docs.unionByName(odd.withColumns({"source": F.lit("s"), "n_chars": F.lit(1)}))).filter("doc_id < 5 or doc_id is null").collect()} >= {None, 4}


def brute_language(text, model):
    """Word by word, from the model's tables."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    total = np.zeros(len(model.languages))
    for w in words:
        if w in model.words:
            total += model.word_logs[model.words[w]]
            continue
        for n in (4, 3, 2, 1):
            marked = f"^{w}$" if n > 1 else w
            rows = [model.grams[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in model.grams]
            if rows:
                total += np.mean([model.gram_logs[r] for r in rows], axis=0)
                break
    odds = np.exp(total - total.max())
    return model.languages[int(total.argmax())], 1 / odds.sum()


def test_predictions_against_word_by_word(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs, words=300, grams=400)
    for r in langid.predict(docs, model).collect():
        if r.lang_pred != "und":
            name, score = brute_language(r.text, model)
            assert (r.lang_pred, round(r.lang_score, 6)) == (name, round(score, 6))


def test_scarce_languages_are_learned_and_tables_bounded(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(500)] + [(900 + i, "der hund und die katze", "de") for i in range(3)] + [(950, "नमस्ते दुनिया", "hi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, rows=30)
    assert model.languages == ["de", "en", "hi"] and "नमस्ते" in model.words
    assert langid.even_shares({"a": 100, "b": 5, "c": 400}, 65) == {"b": 1.0, "a": 0.3, "c": 0.075}
    small = langid.fit(docs, cells=36)
    assert small.word_logs.size <= 36 and len(small.languages) == 3


def test_unseen_words_fall_back():
    m = langid.Model(["a", "b"], {"known": 0}, {"^x": 0, "x": 1}, langid.np.array([[-1.0, -9.0]]), langid.np.array([[-1.0, -5.0], [-4.0, -2.0]]))
    s = langid.Scorer(m, remember=1)
    assert s.unseen("xq").tolist() == [-1.0, -5.0] and s.unseen("qx").tolist() == [-4.0, -2.0] and s.unseen("q").tolist() == [0.0, 0.0]
    assert s.score("known qx qq known")[0] == "a"


def groups_of(texts):
    sets, root = [], list(range(len(texts)))
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())

    def top(x):
        return x if root[x] == x else top(root[x])

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("block", "early"), [(16, 9), (5, 0), (64, 45)])
def test_near_duplicates(spark, monkeypatch, block, early):
    """A large family of near copies, looser ones that link only in chains, copies, shared passages; blocks of several sizes."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "EARLY", early)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = [None, "", "one two", "One  TWO ", "\xa0"]
    for _ in range(70):
        t = list(base)
        for _ in range(r.randint(0, 6)):
            t[r.randrange(120)] = word()
        texts.append(" ".join(t))
    texts += [" ".join([word() for _ in range(40)] + passage) for _ in range(20)] + texts[5:9]
    for _ in range(60):  # most pairs of these share buckets and aren't linked
        t = list(passage * 3)
        for _ in range(r.randint(1, 5)):
            t[r.randrange(180)] = word()
        texts.append(" ".join(t))
    r.shuffle(texts)
    want = groups_of(texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, family string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.linked_groups(df).collect()}
    assert got == {i: (n, g, g == i) for i, (n, g) in enumerate(want)}


def test_unlinked_near_copies(spark, monkeypatch):
    """Of near copies that share buckets and aren't linked, texts are dealt in proportion to the documents, not to the pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    dealt, links_of = [], neardup.links_of

    def counted(placed, *rest):
        dealt.append(placed.count())
        return links_of(placed, *rest)

    monkeypatch.setattr(neardup, "links_of", counted)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(150)], []
    for _ in range(120):
        t = list(base)
        for at in r.sample(range(150), r.choice([1, 2, 2, 3])):
            t[at] = word()
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.linked_groups(df).collect()}
    assert got == dict(enumerate(groups_of(texts)))
    assert sum(dealt) <= 10 * len(texts)  # 816; by buckets and blocks it was 28,689


def test_odd_sketches_never_exceed_the_difference():
    r = np.random.default_rng(3)
    for n in (1, 5, 8, 9, 60, 1000):
        one = r.integers(0, 1 << 63, n).astype(np.uint64)
        for lost in sorted({0, 1, n // 9, n}):
            for more in (0, 1, n // 8 + 1):
                other = np.concatenate([one[lost:], r.integers(0, 1 << 63, more).astype(np.uint64)])
                if len(other):
                    x, y = [(int.from_bytes(b, "little"), 8 * len(b)) for b in map(neardup.odd_sketch, (one, other))]
                    assert neardup.odd_places(x, y) == neardup.odd_places(y, x) <= lost + more


def test_equal_hashes_do_not_link(spark):
    """Words whose polynomial hashes modulo a power of two are equal are different words."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one.upper())]
    got = neardup.linked_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)]


def test_confirmation_is_on_words(monkeypatch):
    """Even with all hashes of runs alike, only documents with the same words link."""
    monkeypatch.setattr(neardup, "hashed", lambda texts: ((9, np.arange(9, dtype=np.uint64), b"") for _ in texts))
    docs = [{"doc_id": i, "label": i, "signature": bytes(neardup.PLACES), "text": t} for i, t in enumerate(["a b c d e f", "u v w x y z", "A b c d e f"])]
    batch = pa.RecordBatch.from_pylist([{"one": docs, "two": []}], schema=pa.schema([(n, pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int64()), ("signature", pa.binary()), ("text", pa.string())]))) for n in ("one", "two")]))
    (links,) = neardup._compare((85, 100), 1e-7, (45, 7))([batch])
    assert links.to_pylist() == [{"a": 0, "b": 2}]


def test_bayes_bounds():
    least = neardup.fewest_matches(0.85, 1e-7)
    assert list(least) == sorted(least) and least[-1] < 0.85 * neardup.PLACES
    assert neardup.fewest_matches(0.85, 1e-2)[0] > least[0]


def test_repeated_ids_and_nulls(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base, "a"), (2, base.upper() + " ", "b"), (3, base + " x", "c"), (3, base + " x", "c2"), (None, base, "h"), (9, "other", "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, family string")
    assert sorted((r.doc_id, r.family) for r in neardup.keep_one_each(df).collect() if r.doc_id) == [(1, "a"), (9, "i")]
    assert neardup.linked_groups(df.limit(0)).count() == 0
