"""Spelling variants: words at an edit distance of one, found by PartEnum signatures of their letters.

A word's letters, each with the number of its occurrence, are a binary vector: two words one edit
apart have vectors at a Hamming distance of at most two. The dimensions are dealt to six parts by
hash; two differences touch at most two of them, so the vectors agree on four parts at least. Each
choice of four parts is a signature: words one edit apart share one of the fifteen. Such words
also share their first three or their last three characters, as they have six or more, which goes into
the join's key. Words that share a key are compared exactly. No pair is missed, and a pair is
compared only under the first of the keys it shares.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Letters that words are made of, and those that are made small.
LETTERS, CAPITALS = "A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARTS, PART_BITS, DIFFERENCES, SHARED = 6, 10, 2, 3


def _small(word: Column) -> Column:
    """A-Z made small, nothing else."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, CAPITALS, CAPITALS.lower()))


def misspelled(doc_id: Column, word: Column, one_in: int) -> Column:
    """The word, one of `one_in` without the character that its checksum (over document and word) names."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def count_words(docs: DataFrame, shortest: int = 6, fewest: int = 5, one_in: int = 199) -> DataFrame:
    """word and n of words with `shortest` characters and `fewest` occurrences over all whole texts (null: none).

    A run of letters shorter than `shortest` can only get shorter. Tasks count before the shuffle, so a frequent word costs a row a task.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), 0)).alias("run"))
    words = runs.select("doc_id", _small(F.col("run")).alias("run")).select(misspelled(F.col("doc_id"), F.col("run"), one_in).alias("word"))
    counts = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= fewest)


def vector_code(word: Column) -> Column:
    """The word's vector as one number: for each part the XOR of the hashes of its dimensions, in 10 bits."""
    letters = F.split(word, "")
    numbered = F.transform(letters, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(F.slice(letters, F.lit(1), i), lambda d: d == c)).alias("k")))
    bits = F.transform(numbered, lambda d: F.xxhash64(d["c"], d["k"]))
    placed = lambda h: F.call_function("shiftleft", F.shiftrightunsigned(h, 40).bitwiseAND(F.lit((1 << PART_BITS) - 1)), (F.pmod(h, F.lit(PARTS)) * PART_BITS).cast("int"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda had, h: had.bitwiseXOR(placed(h)))


def signature_masks() -> list[int]:
    """The bits of each choice of parts that a pair may agree on."""
    part = (1 << PART_BITS) - 1
    return [sum(part << (PART_BITS * p) for p in chosen) for chosen in combinations(range(PARTS), PARTS - DIFFERENCES)]


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs a < b of different words (column word, of SHARED * 2 characters or more; and n) that are one edit apart."""
    masks = signature_masks()
    coded = words.select("word", "n", vector_code(F.col("word")).alias("code"))
    ends = [F.substring("word", 1, SHARED), F.substring("word", -SHARED, SHARED)]
    keys = [F.struct(F.lit(2 * j + side).alias("which"), F.xxhash64(F.lit(2 * j + side), F.col("code").bitwiseAND(F.lit(m)), end).alias("key")) for j, m in enumerate(masks) for side, end in enumerate(ends)]
    rows = coded.select("word", "n", "code", F.explode(F.array(*keys)).alias("k")).select("word", "n", "code", "k.which", "k.key")
    a, b = rows.alias("a"), rows.alias("b")
    # Spark sizes the rows from the words' files, without their thirty keys each: unhinted, it would broadcast them all
    pairs = a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.which") == F.col("b.which")) & (F.col("a.word") < F.col("b.word")))
    apart = F.col("a.code").bitwiseXOR(F.col("b.code"))
    first = F.lit(None)
    for j, m in reversed(list(enumerate(masks))):
        first = F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(j)).otherwise(first)
    side = F.when(F.substring("a.word", 1, SHARED) == F.substring("b.word", 1, SHARED), 0).otherwise(1)
    close = F.abs(F.length("a.word") - F.length("b.word")) <= 1
    pairs = pairs.where(close & (first * 2 + side == F.col("a.which")) & (F.levenshtein("a.word", "b.word", 1) == 1))
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def _roots(forms: DataFrame, largest: int, times: int) -> DataFrame:
    """word and root of words that have a form, by pointer doubling; each step's form is `times` as frequent, which bounds the steps.

    Roots repeat, so their files are a tenth of the rows or less: joins with them are merged by hint, as Spark would broadcast them by the files' size.
    """
    depth = max(1, math.ceil(math.log(max(largest, times), times)))
    found = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(math.ceil(math.log2(depth + 1))):
        up = found.select(F.col("word").alias("up_word"), F.col("root").alias("up_root"))
        found = stage(found.join(up.hint("merge"), F.col("root") == F.col("up_word"), "left").select("word", F.coalesce("up_root", "root").alias("root")), "spelling-roots")
    return found


def variant_report(docs: DataFrame, times: int = 5) -> DataFrame:
    """All words of the documents (columns doc_id, text) with their form: word, form, root, n, n_near, form_n.

    A word's form is its near word of largest n (ties: the smallest), if that has `times` the word's n. Texts that
    are null, empty or without such words add none; repeated rows count again; an empty table gives no row.
    """
    words = stage(count_words(docs), "spelling-words")
    pairs = near_pairs(words)
    both = F.explode(F.array(*[F.struct(F.col(x).alias("word"), F.struct((-F.col(f"{y}_n")).alias("less"), F.col(y).alias("form")).alias("near")) for x, y in ("ab", "ba")]))
    near = pairs.select(both.alias("p")).groupBy("p.word").agg(F.count(F.lit(1)).alias("n_near"), F.min("p.near").alias("best"))
    rows = words.join(near, "word", "left")
    has = -F.col("best.less") >= times * F.col("n")
    rows = stage(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "spelling-forms")
    largest = rows.agg(F.max("n")).first()[0] or 1
    roots = _roots(rows.where(F.col("form").isNotNull()), largest, times)
    return rows.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
