"""Text statistics and robust outlier rules, in DataFrame and SQL functions only.

Statistics of each text are worked out inside its row: nothing is shuffled for them. The
outlier rule is a minimum-covariance-determinant (MCD) estimate per language and source:
concentration steps find the `support` share of rows whose statistics have the tightest
covariance, and rows far from its centre by Mahalanobis distance are rejected.

A step needs the rows with the smallest distances in each group. Distances are counted in
a histogram of fixed resolution per group and cut where the share is reached, so no group
is sorted or gathered. Statistics are transformed and then rounded to whole numbers, so
their sums are exact and the same in every engine and for any order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh, stage

SPACE = r"[\x20\x09-\x0D]"
#: The transformed statistics, in thousandths.
DIMENSIONS = ("word_chars", "symbols", "dup_lines", "repeats")
SCALE = 1000
#: Added to a text's lines and words before the share of repeated ones is taken: one line that stands at both
#: ends of a short text says little.
FEW_LINES, FEW_WORDS = 8, 60


def let(value: Column, use) -> Column:
    """use(value), with value worked out once a row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column, span: int = 8) -> Column:
    """How many of the words lie in a run of `span` words that occurs twice or more in the text.

    Runs are compared by a 64-bit hash. Without a repeated run (nearly every text) the hashes
    alone decide; else they are sorted with their places, and the places of repeated ones are
    walked in order, so the cost is that of sorting however often a run repeats.
    """

    def covered(runs: Column) -> Column:
        pairs = F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = F.filter(p, lambda x, j: ((j > 0) & (x["h"] == F.get(p, j - 1)["h"])) | (x["h"] == F.get(p, j + 1)["h"]))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def length(at: Column) -> Column:
            own = F.transform(at, lambda i, j: F.least(F.lit(span), F.coalesce(F.get(at, j + 1) - i, F.lit(span))))
            return F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x)

        return let(let(pairs, places), length)

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (span - 1)), lambda i: F.xxhash64(F.slice(w, i, span)))
        checked = let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0).cast("long")).otherwise(covered(r)))
        return F.when(F.size(w) >= span, checked).otherwise(F.lit(0).cast("long"))

    return let(words, of)


def text_statistics(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (null: 0 each)."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"), F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x)).alias("c")))
    return {
        "words": both,
        "symbols": F.char_length(t).cast("long") - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", "")).cast("long"),
        "lines": F.when(F.instr(t, "\n") == 0, F.struct(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("dup"))).otherwise(
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
        ),
    }


def with_statistics(docs: DataFrame, text_col: str = "text", name: str | None = None) -> tuple[DataFrame, str]:
    """The rows with one struct column of statistics, and the column's name."""
    name = name or fresh(docs, "quality")
    s = text_statistics(column(docs, text_col))
    rows = docs.withColumn(name, F.struct(*[v.alias(k) for k, v in s.items()]))
    q = F.col(name)
    n, r, c = q["words"]["n"], q["words"]["r"], q["words"]["c"]
    failed = (n < 20) | (100 * r > 30 * n)
    per = F.greatest(n, F.lit(1)).cast("double")
    whole = lambda x: F.round(x * SCALE).cast("long")
    vector = F.array(
        whole(F.log(F.greatest(c, F.lit(1)) / per)),
        whole(F.sqrt(q["symbols"] / F.greatest(c, F.lit(1)).cast("double"))),
        whole(F.sqrt(q["lines"]["dup"] / (q["lines"]["n"] + FEW_LINES).cast("double"))),
        whole(F.sqrt(r / (n + FEW_WORDS).cast("double"))),
    )
    return rows.withColumn(name, F.struct(n.alias("n_words"), c.alias("word_chars"), q["symbols"].alias("n_symbols"), q["lines"]["dup"].alias("n_dup_lines"), r.alias("n_repeat_words"), failed.alias("base_failed"), vector.alias("x"))), name


# ---------------------------------------------------------------- small dense algebra as columns

D = len(DIMENSIONS)
#: Least standard deviation of each transformed statistic, in its own units: differences below are never odd.
#: Where a group never strays, each statistic by itself passes CUTOFF at 6.3 times its floor: words half as long again,
#: a symbol for every 16 characters, 40 repeated lines of 100, and 27 of 100 words in repeated runs of a long text
#: (the base rule asks for 30). A line printed at both ends of a text passes neither alone nor in sum.
FLOOR = (0.06, 0.04, 0.1, 0.079)


def _moments(x: Column) -> list[Column]:
    sums = [F.sum(x[i]).alias(f"s{i}") for i in range(D)]
    crossed = [F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i in range(D) for j in range(i, D)]
    return [F.count(F.lit(1)).alias("m"), *sums, *crossed]


def _centre_and_factor(inflate: float) -> dict[str, Column]:
    """Centre c0.. and the Cholesky factor l00, l10.. of the covariance, from the sums.

    The covariance of the tightest share is inflated to stand for all rows, and the squares of FLOOR are
    added, so it can be factored when a statistic is constant (most texts have no symbol).
    """
    m = F.col("m").cast("double")
    out = {f"c{i}": F.col(f"s{i}") / m for i in range(D)}

    def cov(i: int, j: int) -> Column:
        raw = F.col(f"s{i}{j}") / m - (F.col(f"s{i}") / m) * (F.col(f"s{j}") / m)
        return raw * inflate + (F.lit((FLOOR[i] * SCALE) ** 2) if i == j else F.lit(0.0))

    low: dict[tuple[int, int], Column] = {}
    steps = []
    for i in range(D):
        for j in range(i + 1):
            rest = cov(j, i)
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            low[i, j] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}")
            steps.append((f"l{i}{j}", low[i, j]))
    return out | dict(steps)


def _factored(sums: DataFrame, keys: list[str], inflate: float) -> DataFrame:
    """Row by row of the factor: each entry needs the ones before it."""
    for name, expr in _centre_and_factor(inflate).items():
        sums = sums.withColumn(name, expr)
    return sums.select(*keys, *[f"c{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)], "m")


def _distance(x: Column, of: str = "") -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i in range(D):
        rest = x[i] - F.col(f"{of}c{i}")
        for k in range(i):
            rest = rest - F.col(f"{of}l{i}{k}") * z[k]
        z.append(rest / F.col(f"{of}l{i}{i}"))
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def fit_mcd(vectors: DataFrame, keys: list[str], support: float = 0.75, steps: int = 3, least: int = 200) -> DataFrame:
    """MCD centre and factor for each group; vectors: columns of `keys` and x, staged.

    The first share is the rows nearest the group's componentwise middle in FLOOR's units,
    so a minority of odd rows, up to 1 - `support`, doesn't sway it. Each of `steps`
    concentration steps then refits on the nearest share. Groups with fewer than `least` rows are left out.
    """
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    large = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)

    def nearest(distance: Column, groups: DataFrame) -> DataFrame:
        """The rows of each group up to the histogram bin in which the share is reached, as moments."""
        bin_of = F.floor(F.log1p(distance) * 64).cast("int")
        rows = vectors.alias("v").join(groups.alias("g"), on).select(*[F.col(f"v.{k}").alias(k) for k in keys], "v.x", bin_of.alias("bin"))
        by_bin = rows.groupBy(*keys, "bin").agg(*_moments(F.col("x")))
        up_to = Window.partitionBy(*keys).orderBy("bin")
        run = F.sum("m").over(up_to.rowsBetween(Window.unboundedPreceding, -1))
        total = F.sum("m").over(Window.partitionBy(*keys))
        kept = by_bin.withColumns({"run": F.coalesce(run, F.lit(0)), "total": total}).filter(F.col("run") < F.ceil(F.col("total") * F.lit(support)))
        names = ["m", *[f"s{i}" for i in range(D)], *[f"s{i}{j}" for i in range(D) for j in range(i, D)]]
        return kept.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])

    # the middle of each statistic: the value of the histogram bin in which half the rows are reached
    parts = vectors.alias("v").join(large.alias("g"), on).select(*[F.col(f"v.{k}").alias(k) for k in keys], F.posexplode("v.x").alias("i", "value"))
    parts = parts.withColumn("bin", F.floor(F.col("value") / 10)).groupBy(*keys, "i", "bin").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy(*keys, "i").orderBy("bin")
    parts = parts.withColumns({"run": F.sum("n").over(up_to), "total": F.sum("n").over(Window.partitionBy(*keys, "i"))})
    middle = parts.filter(F.col("run") * 2 >= F.col("total")).groupBy(*keys, "i").agg(F.min("bin").alias("bin"))
    middle = middle.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("bin") * 10.0 + 5.0)).alias(f"c{i}") for i in range(D)])
    first = [F.lit(FLOOR[i] * SCALE if i == j else 0.0).alias(f"l{i}{j}") for i in range(D) for j in range(i + 1)]
    groups = middle.select(*keys, *[f"c{i}" for i in range(D)], *first)
    # the share's covariance is smaller than all rows'; for normal rows in 4 dimensions about 1 / 1.6 at three quarters
    inflate = 1.0 / support**1.6
    for _ in range(steps):
        groups = stage(_factored(nearest(_distance(F.col("v.x"), "g."), groups), keys, inflate), "mcd")
    return groups


#: Squared distance of the last one in about 10 million normal rows in 4 dimensions.
CUTOFF = 40.0


def judge(rows: DataFrame, name: str, lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, kept: str = "kept", support: float = 0.75, least: int = 200) -> DataFrame:
    """Add the boolean `kept` to staged rows with statistics in `name`.

    A row that failed the base rule isn't kept, and takes no part in the estimates. Others are
    held against the estimate of their language and source; of their language, or of all rows,
    where there are fewer than `least` to learn from; and are kept where even all are too few.
    A row is rejected if its squared distance exceeds `cutoff` and it lies on the bad side
    (more symbols, repeats or repeated lines, or word lengths off) – which the distance alone says, since
    the centre of those statistics is near zero. Null languages and sources are groups.
    """
    lang, source = column(rows, lang_col).cast("string"), column(rows, source_col).cast("string")
    nothing = F.lit(None).cast("string")
    levels = F.array(*[F.struct(F.lit(i).alias("level"), x.alias("lang"), y.alias("source")) for i, (x, y) in enumerate(((lang, source), (lang, nothing), (nothing, nothing)))])
    vectors = rows.filter(~F.col(name)["base_failed"]).select(F.explode(levels).alias("k"), F.col(name)["x"].alias("x")).select("k.*", "x")
    params = [f"c{i}" for i in range(D)] + [f"l{i}{j}" for i in range(D) for j in range(i + 1)]
    fits = fit_mcd(vectors, ["level", "lang", "source"], support=support, least=least)
    out, found = rows, []
    for level in range(3):
        box, f_lang, f_source = fresh(rows, f"mcd{level}"), fresh(rows, f"mcd_lang{level}"), fresh(rows, f"mcd_source{level}")
        fit = fits.filter(F.col("level") == level).select(F.col("lang").alias(f_lang), F.col("source").alias(f_source), F.struct(*params).alias(box))
        on = lang.eqNullSafe(F.col(f_lang)) if level < 2 else F.col(f_lang).isNull()
        if level == 0:
            on = on & source.eqNullSafe(F.col(f_source))
        # the last level is one row; the others are as many as groups, which Spark broadcasts only below its threshold
        out = out.join(F.broadcast(fit) if level == 2 else fit, on, "left").drop(f_lang, f_source)
        found.append(box)
    fit = F.coalesce(*[F.col(b) for b in found])
    best = fresh(rows, "mcd")
    out = out.withColumn(best, fit)
    distance = _distance(F.col(name)["x"], f"{best}.")
    verdict = ~F.col(name)["base_failed"] & F.coalesce(distance <= cutoff, F.lit(True))
    return out.withColumn(kept, verdict).drop(*found, best)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null or empty text has no words and fails the base rule. Null languages and sources are groups of their own. Repeated rows
    count and get the same verdict each, as do rows with equal statistics; an empty table gives no row.
    """
    wanted = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"), column(docs, lang_col).alias("lang"), column(docs, source_col).alias("source"))
    measured, name = with_statistics(wanted, name="q")
    rows = judge(stage(measured.drop("text"), "statistics"), name)
    return rows.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows the rules keep, with the input's columns, whatever their names.

    Null and empty texts go, as they fail the base rule; repeated rows stay or go together; an empty table stays empty.
    """
    measured, name = with_statistics(docs)
    staged = stage(measured, "measured")
    kept = fresh(staged, "kept")
    return judge(staged, name, kept=kept).filter(F.col(kept)).select(*[column(staged, c) for c in docs.columns])
