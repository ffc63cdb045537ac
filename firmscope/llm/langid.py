"""Language identification: known words first, and for unseen words ever shorter character n-grams.

A word the model knows adds its log frequency in each language. An unseen word is looked
up by its longest character n-grams (its ends marked); if none of that length is known,
by shorter ones, down to single letters; the known ones of one length add their mean.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column

def _marks(found: list[int]) -> str:
    """Code points as ranges of a character class."""
    starts = [c for i, c in enumerate(found) if not i or found[i - 1] != c - 1]
    ends = [c for i, c in enumerate(found) if i + 1 == len(found) or found[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


#: The combining marks.
MARKS = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Mn", "Mc")]
IS_MARK = np.zeros(sys.maxunicode + 1, bool)
IS_MARK[MARKS] = True
WORDS = re.compile(r"[^\W\d_]+")
#: With the marks that many scripts write vowels with.
MARKED_WORDS = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{_marks(MARKS)}])*")
LONGEST = 4
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters, with the combining marks behind them, in small letters."""
    low = text.lower()
    marked = not low.isascii() and IS_MARK[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)].any()
    return (MARKED_WORDS if marked else WORDS).findall(low)


@dataclass(frozen=True)
class Model:
    """languages; of each known word and n-gram the row of its log frequencies per language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray


def in_fold(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32 of the id as text leaves that remainder (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, word, n), summed over each portion of texts."""
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.update((lang, w) for w in words_of(text))
            if len(held) > 200_000:
                yield rows()
                held.clear()
    if held:
        yield rows()


#: Numbers that a model's tables of words, and of n-grams, hold at most (each has a row for a key and a column for a language).
CELLS = 16_000_000
#: Languages up to which their table of shares (a row each) is sent to every task.
MANY = 10_000
#: Parts in which each language's keys are ranked before the best of all parts are.
PARTS = 16


def even_shares(counts: dict[str, int], rows: int) -> dict[str, float]:
    """The share of each language's rows to learn from, about `rows` in all: scarce languages whole, the others equally many rows."""
    left, shares = rows, {}
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        most = left // (len(counts) - i)
        shares[lang] = min(1.0, most / n)
        left -= min(n, most)
    return shares


def _best(counts: DataFrame, by: list[Column], key: str, most: int) -> DataFrame:
    """The `most` most frequent keys of each group; ranked in parts first, so that no task ranks all of a group's keys."""
    order = [F.desc("n"), F.col(key)]
    parts = counts.withColumn("r", F.row_number().over(Window.partitionBy(*by, F.pmod(F.xxhash64(key), F.lit(PARTS))).orderBy(*order))).filter(F.col("r") <= most)
    return parts.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("r") <= most).select("lang", key, "n")


def fit(labelled: DataFrame, rows: int = 20_000, words: int = 40_000, grams: int = 12_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", cells: int = CELLS) -> Model:
    """Learn from a sample of about `rows` labelled rows (chosen by a hash of the id; all if there are fewer).

    Each language has an equal part in the sample, scarce ones all their rows, so that none is
    missed. The `words` most frequent words and `grams` most frequent n-grams of each length and
    language are kept, and with many languages fewer, so that no table exceeds `cells` numbers: the model
    and what is gathered for it are bounded whatever the corpus and its languages. Rows with a null
    text or language teach nothing. Without any labelled row the model knows no language.
    """
    taught = labelled.select(column(labelled, lang_col).cast("string").alias("lang"), column(labelled, text_col).cast("string").alias("text"), column(labelled, id_col).cast("string").alias("id"))
    taught = taught.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in taught.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if sum(sizes.values()) > rows:
        shares = labelled.sparkSession.createDataFrame([(k, int((1 << 30) * v)) for k, v in even_shares(sizes, rows).items()], "lang string, upto long")
        chosen = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 30)) < F.col("upto")
        taught = taught.join(F.broadcast(shares) if len(sizes) <= MANY else shares, "lang").filter(chosen)
    most = max(1, cells // max(1, len(sizes)) ** 2)
    words, grams = min(words, most), min(grams, most // LONGEST + 1)
    counts = taught.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).cache()
    top = _best(counts, [F.col("lang")], "word", words).toArrow()  # bounded by `words` a language
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    lengths = F.array(*[F.lit(n) for n in range(1, LONGEST + 1)])
    cut = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(marked) - n + 1, F.lit(1))), lambda i: F.substring(marked, i, n))))
    pieces = counts.select("lang", F.explode(cut).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top_grams = _best(pieces, [F.col("lang"), F.char_length("gram")], "gram", grams).toArrow()
    counts.unpersist()
    languages = sorted(pc.unique(top["lang"]).to_pylist())
    known, word_logs = _logs(top, "word", languages, lambda _: 0)
    pieces_known, gram_logs = _logs(top_grams, "gram", languages, len)
    return Model(languages, known, pieces_known, word_logs, gram_logs)


def _logs(rows: pa.Table, name: str, languages: list[str], order) -> tuple[dict[str, int], np.ndarray]:
    """Rows (lang, key, n) to log frequencies with a half count added, per language and order of the key."""
    keys = {k: i for i, k in enumerate(sorted(pc.unique(rows[name]).to_pylist()))}
    counts = np.zeros((len(keys), len(languages)))
    at_key = pc.index_in(rows[name], pa.array(list(keys), pa.string())).to_numpy()
    counts[at_key, pc.index_in(rows["lang"], pa.array(languages, pa.string())).to_numpy()] = rows["n"].to_numpy()
    of = np.array([order(k) for k in keys])
    logs = np.zeros_like(counts)
    for o in set(of.tolist()):
        at = of == o
        part = counts[at] + 0.5
        logs[at] = np.log(part / part.sum(axis=0))
    return keys, logs


class Scorer:
    """Sums a text's words under a model; remembers what unseen words came to (bounded)."""

    def __init__(self, model: Model, remember: int = 200_000):
        self.model, self.remember = model, min(remember, CELLS // max(1, len(model.languages)))
        self.step = max(1, min(self.remember, (1 << 17) // max(1, len(model.languages))))  # unseen words looked up at a time
        self._forget()

    def _forget(self) -> None:
        known = len(self.model.words)
        self.logs = np.zeros((known + self.remember, len(self.model.languages)))
        self.logs[:known] = self.model.word_logs
        self.place = dict(self.model.words)

    def unseen(self, word: str) -> np.ndarray:
        return self.all_unseen([word])[0]

    def all_unseen(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean of its n-grams of the greatest length of which any is known."""
        known = self.model.grams.get
        rows: list[int] = []
        starts, at = [], []
        for k, word in enumerate(words):
            marked = f"^{word}$"
            for n in range(LONGEST, 0, -1):
                cut = word if n == 1 else [marked[i : i + n] for i in range(len(marked) - n + 1)]
                found = [r for r in map(known, cut) if r is not None]
                if found:
                    starts.append(len(rows))
                    at.append(k)
                    rows += found
                    break
        out = np.zeros((len(words), len(self.model.languages)))
        if rows:
            sizes = np.diff(np.array([*starts, len(rows)]))
            out[at] = np.add.reduceat(self.model.gram_logs[rows], starts, axis=0) / sizes[:, None]
        return out

    def score(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior probability under equal priors."""
        words = words_of(text) if text else []
        if not self.model.languages or not any(any(map(str.isalpha, w)) for w in words):  # a word may be of signs like ½ alone
            return UNKNOWN, 0.0
        place = self.place
        total = np.zeros(len(self.model.languages))
        for at in range(0, len(words), 1 << 16):
            some = words[at : at + (1 << 16)]
            new = list(set(some).difference(place))
            for k in range(0, len(new), self.step):
                part = new[k : k + self.step]
                if len(place) + len(part) > len(self.logs):
                    self._forget()
                    place = self.place
                self.logs[len(place) : len(place) + len(part)] = self.all_unseen(part)
                place.update(zip(part, range(len(place), len(place) + len(part)), strict=True))
            try:
                rows = np.fromiter(map(place.__getitem__, some), np.int64, len(some))
                total += self.logs[rows].sum(axis=0)
            except KeyError:  # forgotten half way: word by word
                for w in some:
                    total += self.logs[place[w]] if w in place else self.unseen(w)
        best = int(total.argmax())
        return self.model.languages[best], 1 / sum(math.exp(max(-700.0, v - total[best])) for v in total.tolist())


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred: str = "lang_pred", score: str = "lang_score", keep: float | None = None) -> DataFrame:
    """All rows with the predicted language and its posterior added, from the text alone.

    Null texts and texts without a letter are "und" with score 0. With `keep`, only rows
    with a language of at least that score are returned, with the input's columns. Columns
    of the added names are replaced.
    """
    docs = docs if keep is not None else docs.drop(pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit's `words` and `grams`
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column(at).to_pylist()]
            if keep is not None:
                yield batch.filter(pa.array([p != UNKNOWN and s >= keep for p, s in found], pa.bool_()))
                continue
            added = [pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, pred, score])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    added = [] if keep is not None else [StructField(pred, StringType()), StructField(score, DoubleType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that aren't held out.

    A text that is null, empty or without a letter is `und` with score 0. Rows with a null language teach nothing; where none
    teach, all are `und`. Languages of equal score: the first by name. Repeated rows get the same result each; an empty table gives no row.
    """
    model = fit(docs.filter(~in_fold(column(docs, id_col))), text_col=text_col, lang_col=lang_col, id_col=id_col)
    rows = docs.select(column(docs, id_col).alias("doc_id"), in_fold(column(docs, id_col)).alias("held_out"), column(docs, text_col).alias("text"))
    return predict(rows, model, score="score").drop("text")


def keep_identified(docs: DataFrame, keep: float = 0.5) -> DataFrame:
    """The rows whose language is told with at least that probability, with the input's columns.

    Null and empty texts and those without a letter go; repeated rows stay or go together; an empty table stays empty.
    """
    return predict(docs, fit(docs), keep=keep)
