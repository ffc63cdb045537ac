"""Edge cases of operators that other tests leave out: equal scores, nobody to learn from, very long texts."""

import zlib

from firmscope.llm import langid, quality, sharding
from firmscope.llm.common import stage


def test_equal_scores_of_two_languages(spark):
    """Both languages have the same texts: the first by name is told, with half the probability."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:200]
    rows = [(i, "same words in both " * 3, ["zz", "aa"][k % 2]) for k, i in enumerate(ids)] + [(1000, "same words", None), (1001, "123 ...", None)]
    got = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[1000] == ("aa", 0.5) and got[1001] == ("und", 0.0)


def test_nobody_to_learn_from(spark):
    rows = [(i, "words without a language", None) for i in range(5)]
    got = langid.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == 5 and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_very_long_texts(spark):
    """Two million characters: counted whole by the statistics, and in one shard with their copies."""
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(i, t, "en", "s") for i, t in enumerate([long, long, "short text", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality_report(docs).collect()}
    assert got[0].n_words == 300_000 and got[0].word_chars == sum(map(len, long.split())) and got[0].n_repeat_words == 300_000 and got[0].base_failed
    measured = sharding.measure(docs.select("doc_id", "text")).drop("text")
    placed = {r.doc_id: (r.shard_size, r.shard) for r in sharding.assign_shards(stage(measured, "edges")).collect()}
    assert {k: s for k, (s, _) in placed.items()} == {0: len(long) + 1, 1: len(long) + 1, 2: 11, 3: 1, 4: 1}
