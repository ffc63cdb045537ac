"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

A source with weight w may start its j-th block (from 1) at slot floor((j - 1) / w) and must
have it done by slot ceil(j / w). In each slot runs, of the blocks released, the one with the
earliest deadline. Then every prefix of the schedule holds each source's share to less than
one block. Weights aren't rounded to a period: they are whole numbers over their sum where their ratio is that of
whole numbers (as given, in units of the least, or of up to six decimal places), else units of 2 ** -40 of the sum.

Any stretch of the schedule can be worked out by itself. At a slot T each source has had floor(w T)
blocks, or one more, if the block that is under way at T counts as done. How many of those blocks are done is
fixed; which ones is settled at each T alone, by the same two conditions that any schedule meets: those left must
fit in behind T by their deadlines, those done must fit in before T from their releases. Going
through the deadlines, as many blocks as must be done are taken, those released first before
others. A stretch between two such slots is then a set of unit jobs with windows that is known to
fit, and earliest deadline first finds an order. So a long schedule is as many rows as it has stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, fresh, rank_in_group, stage

#: Slots of a stretch, and units of the sum of weights that are in no whole ratio.
STRETCH, UNITS = 1024, 1 << 40


def source_units(sources: DataFrame) -> DataFrame:
    """One row: s, the sources in the order that breaks ties (heavier, then by name; source, weight, blocks, u), and `total`, the sum of u.

    sources: source, weight (above 0), blocks. u / total is the share that the schedule holds a source to.
    """
    item = F.struct((-F.col("weight")).alias("minus"), F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "source", "weight", "blocks")
    one = sources.agg(F.array_sort(F.collect_list(item)).alias("s")).where(F.size("s") > 0)
    one = one.withColumn("sum", F.aggregate("s", F.lit(0.0), lambda had, x: had + x["weight"]))
    scales = F.array(F.lit(1.0), F.lit(1.0) / F.array_min(F.transform("s", lambda x: x["weight"])), *[F.lit(10.0**k) for k in range(1, 7)])
    whole = lambda f: F.forall("s", lambda x: F.abs(x["weight"] * f - F.round(x["weight"] * f)) <= x["weight"] * f * 1e-12) & (F.col("sum") * f <= UNITS)
    one = one.withColumn("scale", F.get(F.filter(scales, whole), F.lit(0)))  # null: no small whole numbers stand in the weights' ratio
    part = lambda x: F.coalesce(F.round(x["weight"] * F.col("scale")).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(x["weight"] / F.col("sum") * UNITS).cast("long")))
    one = one.withColumn("u", F.transform("s", part))
    all_of = F.aggregate("u", F.lit(0).cast("long"), lambda had, x: had + x)
    one = one.withColumn("total", F.when(F.col("scale").isNotNull(), all_of).otherwise(F.lit(UNITS))).withColumn("left", F.col("total") - all_of)
    units = F.transform("s", lambda x, i: F.struct(x["source"].alias("source"), x["weight"].alias("weight"), x["blocks"].alias("blocks"), (F.get("u", i) + F.when(i == 0, F.col("left")).otherwise(0)).alias("u")))
    return one.select(units.alias("s"), "total")


def _div(a: Column, b: Column) -> Column:
    """a / b without the fraction, for whole numbers of at least 0."""
    return F.call_function("div", a, b)


def _done(u: Column, slots: Column, total: Column, had: Column) -> tuple[Column, Column]:
    """Quotient and rest of (had + u * slots) / total, for slots below 2 ** 42, without leaving 64 bits."""
    high, low = F.shiftright(slots, 20), slots.bitwiseAND(F.lit((1 << 20) - 1))
    first = u * high
    rest = (first % total) * (1 << 20) + u * low + had
    return _div(first, total) * (1 << 20) + _div(rest, total), rest % total


def _up(a: Column, b: Column) -> Column:
    """a / b rounded up, for a of at least 0."""
    return _div(a + b - 1, b)


def _bound(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def stretch_starts(units: DataFrame, many: int, stretch: int) -> DataFrame:
    """k (0 to `many`), s, total, and at: of each source at slot k * stretch the blocks of its weight (base), the rest of the next one, and 1 if that one is done."""
    rows = units.sparkSession.range(many + 1).withColumnRenamed("id", "k").crossJoin(F.broadcast(units))  # units is one row
    slot, total, zero = F.col("k") * stretch, F.col("total"), F.lit(0).cast("long")

    def at(x: Column) -> Column:
        base, rest = _done(x["u"], slot, total, zero)
        return F.struct(base.alias("base"), rest.alias("rest"), x["u"].alias("u"))

    def under(at: Column) -> Column:
        """The blocks under way: due and free (how far ahead its deadline is, how far back its release, negative), i; by deadline."""
        due = F.transform(at, lambda x, i: F.when(x["rest"] > 0, F.struct(_up(total - x["rest"], x["u"]).alias("due"), (-_up(x["rest"], x["u"])).alias("free"), i.alias("i"))))
        return F.sort_array(F.filter(due, lambda x: x.isNotNull()))

    def jobs(at: Column, blocks: Column) -> Column:
        """`must`: how many of the blocks up to this deadline have to be done before; given with the last block of a deadline."""
        whole = lambda y: F.aggregate(at, zero, lambda had, x: had + F.greatest(_done(x["u"], y, total, x["rest"])[0] - F.when(x["rest"] > 0, 1).otherwise(0), zero))
        last = lambda x, n: (n + 1 == F.size(blocks)) | (F.get(blocks, n + 1)["due"] > x["due"])
        must = lambda x, n: F.when(last(x, n), n + 1 - (x["due"] - whole(x["due"]))).otherwise(zero)
        return F.transform(blocks, lambda x, n: F.struct(x["free"].alias("free"), x["i"].alias("i"), must(x, n).alias("must")))

    def take(state: Column, job: Column) -> Column:
        waiting = F.concat(state["waiting"], F.array(F.struct(job["free"].alias("free"), job["i"].alias("i"))))
        need = F.greatest(job["must"] - F.size(state["done"]), zero).cast("int")
        some = _bound(
            F.sort_array(waiting), lambda w: F.struct(F.slice(w, need + 1, F.size(w)).alias("waiting"), F.concat(state["done"], F.transform(F.slice(w, F.lit(1), need), lambda y: y["i"])).alias("done"))
        )
        return F.when(need > 0, some).otherwise(F.struct(waiting.alias("waiting"), state["done"].alias("done")))  # sorted only where some are taken

    start = F.struct(F.array().cast("array<struct<free:bigint,i:int>>").alias("waiting"), F.array().cast("array<int>").alias("done"))

    def settled(at: Column) -> Column:
        number = slot - F.aggregate(at, zero, lambda had, x: had + x["base"])
        rest = lambda x: F.transform(F.slice(F.sort_array(x["waiting"]), F.lit(1), (number - F.size(x["done"])).cast("int")), lambda y: y["i"])
        done = F.aggregate(_bound(under(at), lambda blocks: jobs(at, blocks)), start, take, lambda x: F.concat(x["done"], rest(x)))
        return _bound(done, lambda d: F.transform(at, lambda x, i: F.struct(x["base"].alias("base"), x["rest"].alias("rest"), F.array_contains(d, i).cast("long").alias("ahead"))))

    return rows.select("k", "s", "total", _bound(F.transform("s", at), settled).alias("at"))


def schedule(units: DataFrame, many: int, stretch: int = STRETCH) -> DataFrame:
    """The schedule's first `many` stretches: slot, source, weight, block (of its source, from 0). units: of `source_units`.

    A source that has run out leaves its slots empty, so there is a row a block.
    """
    starts = stage(stretch_starts(units, many, stretch), "mix-starts")
    ends = starts.select((F.col("k") - 1).alias("k"), F.transform("at", lambda x: x["base"] + x["ahead"]).alias("upto"))
    rows = starts.join(ends, "k")
    total, far = F.col("total"), F.lit((1 << 62) - 1)

    def window(i: Column, had: Column) -> Column:
        """Of the source's next block: release and deadline within the stretch."""
        u, rest = F.get("s", i)["u"], F.get("at", i)["rest"]
        left = had < F.get("upto", i) - F.get("at", i)["base"]
        release = F.when(left, _div(F.greatest(had * total - rest, F.lit(0).cast("long")), u)).otherwise(far)
        return F.struct(had.alias("had"), release.alias("release"), F.least(_up((had + 1) * total - rest, u), F.lit(stretch).cast("long")).alias("due"))

    def step(state: Column, slot: Column) -> Column:
        ready = F.transform(state["next"], lambda x, i: F.when(x["release"] <= slot, F.struct(x["due"].alias("due"), i.alias("i"), x["had"].alias("had"))))
        return _bound(
            F.array_min(F.filter(ready, lambda x: x.isNotNull())),
            lambda p: F.struct(
                F.transform(state["next"], lambda x, i: F.when(i == p["i"], window(i, x["had"] + 1)).otherwise(x)).alias("next"),
                F.concat(state["run"], F.array(F.struct(p["i"].alias("i"), p["had"].alias("had")))).alias("run"),
            ),
        )

    start = F.struct(F.transform("at", lambda x, i: window(i, x["ahead"])).alias("next"), F.array().cast("array<struct<i:int,had:bigint>>").alias("run"))
    run = F.aggregate(F.sequence(F.lit(0), F.lit(stretch - 1)), start, step, lambda x: x["run"])
    of = lambda p: F.get("s", p["i"])
    named = F.transform(run, lambda p: F.struct(of(p)["source"].alias("source"), of(p)["weight"].alias("weight"), (F.get("at", p["i"])["base"] + p["had"]).alias("block"), of(p)["blocks"].alias("blocks")))
    slots = rows.select("k", F.posexplode(named).alias("n", "p")).where("p.block < p.blocks")
    return slots.select((F.col("k") * stretch + F.col("n")).alias("slot"), "p.source", "p.weight", "p.block")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = 16, stretch: int = STRETCH, source_col: str = "source", id_col: str = "doc_id", power: float = 0.5) -> DataFrame:
    """All rows with the columns mix_weight, mix_block, mix_slot and mix_place added.

    weights: rows (source, weight); by default a source weighs its row count to `power`, so a
    source with a third of all rows is toned down. Rows of a source are taken in id order,
    `block_rows` to a block. mix_slot is the block's slot in the schedule and mix_place the
    row's place in its block: sorted by both, any prefix that ends before the first source
    runs out holds each source to its weight with less than one block's deviation (and T / 2 ** 41 blocks after T slots
    from weights in no whole ratio). A source that has run out leaves its slots empty and the others keep their
    order, so work grows with the slots up to the last source's last block. No row is dropped or repeated. All sources
    with their weights are held in one row, never on the driver. A null source is a source. Sources without a weight get the
    smallest given. Columns of the added names are replaced. An empty table gives no rows.
    """
    docs = docs.drop("mix_weight", "mix_block", "mix_slot", "mix_place")
    source, doc = fresh(docs, "mix_source"), fresh(docs, "mix_id")
    rank = fresh(docs, "mix_rank")
    rows = docs.withColumns({source: column(docs, source_col).cast("string"), doc: column(docs, id_col).cast("long")})
    counts = rows.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        sources = counts.select("source", "n", F.pow("n", F.lit(power)).alias("weight"))
    else:
        given = weights.select(F.col("source").alias("g"), F.col("weight").cast("double").alias("w"))
        least = given.agg(F.min("w").alias("least"))
        sources = counts.join(given, F.col("source").eqNullSafe(F.col("g")), "left").crossJoin(F.broadcast(least)).select("source", "n", F.coalesce("w", "least", F.lit(1.0)).alias("weight"))
    blocks = _div(F.col("n") + (block_rows - 1), F.lit(block_rows))
    units = stage(source_units(sources.select("source", "weight", blocks.alias("blocks"))), "mix-units")
    last = units.select(F.array_max(F.transform("s", lambda x: F.ceil(x["blocks"] * (F.col("total") / x["u"])))).alias("slots")).first()
    plan = schedule(units, (int(last["slots"]) // stretch + 1) if last else 0, stretch)
    others = [c for c in docs.columns]
    ties = [F.xxhash64(*[column(rows, c) for c in others if dict(docs.dtypes)[c][:3] != "map"])]
    numbered = rank_in_group(rows, [source], doc, ties, rank)
    p_source, p_weight, p_block, p_slot = (fresh(numbered, f"mix_p_{n}") for n in ("source", "weight", "block", "slot"))
    plan = plan.select(F.col("source").alias(p_source), F.col("weight").alias(p_weight), F.col("block").alias(p_block), F.col("slot").alias(p_slot))
    block = _div(F.col(rank), F.lit(block_rows))
    joined = numbered.join(plan, F.col(source).eqNullSafe(F.col(p_source)) & (block == F.col(p_block)))
    return joined.select(
        *[column(joined, c) for c in others], F.col(p_weight).alias("mix_weight"), block.alias("mix_block"), F.col(p_slot).alias("mix_slot"), (F.col(rank) % block_rows).alias("mix_place")
    )
