"""Shards by vector bin packing: bytes, tokens and rows balanced together.

Rows of equal text form a group that one shard takes whole. Groups are far too many to
place one by one, so small ones are bundled by their hash into a fixed number of bundles;
groups that outweigh a bundle many times stand alone. Bundles and large groups, at most a
few thousand vectors whatever the corpus, are placed largest first, each where the dot
product of its vector with the shard's residual capacity is highest. A group larger than
a shard's fair share can't be kept whole in a balanced layout: it is cut into slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, fresh

BUNDLES = 4096
#: Dimensions: bytes, tokens, rows.
DIMENSIONS = ("bytes", "tokens", "rows")


def place_by_dot_product(items: list[tuple[int, int, int]], shards: int) -> list[int]:
    """The shard of each vector. Vectors and capacities are scaled to an equal share of 1 a shard.

    Largest first (by the sum of scaled sizes, then by place). A shard whose residual would
    turn negative in some dimension is taken only if every shard's would.
    """
    totals = [max(1, sum(x[k] for x in items)) for k in range(3)]
    scaled = [[x[k] * shards / totals[k] for k in range(3)] for x in items]
    left = [[1.0, 1.0, 1.0] for _ in range(shards)]
    placed = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-sum(scaled[i]), i)):
        v = scaled[i]

        def worth(s: int, v=v) -> tuple[bool, float, int]:
            r = left[s]
            return (all(r[k] >= v[k] for k in range(3)), sum(v[k] * r[k] for k in range(3)), -s)

        best = max(range(shards), key=worth)
        placed[i] = best
        left[best] = [left[best][k] - v[k] for k in range(3)]
    return placed


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add what placing needs and the text is read for: MEASURES (columns of these names are replaced)."""
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "shard_size": F.octet_length(text).cast("long") + 1,
            "shard_text_crc32": F.crc32(text.cast("binary")),
            "shard_key": F.xxhash64(text),
            "shard_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
        }
    )


MEASURES = ["shard_size", "shard_text_crc32", "shard_key", "shard_tokens"]


def assign_shards(measured: DataFrame, shards: int = 16, bundles: int = BUNDLES, id_col: str = "doc_id") -> DataFrame:
    """All rows of a measured table (see `measure`; best staged, as it is read three times) with shard and shard_slot added.

    Size: UTF-8 bytes of the text plus 1. Tokens: runs of characters other than white space
    (what a tokenizer's count follows). Null text counts as empty and groups with it. Slots
    number a shard's rows from 0 without gaps, in order of item, slice and id; rows equal in
    id and text change places freely. Columns named shard and shard_slot are replaced, as those of MEASURES are
    by `measure`; other columns may have any name. An empty table gives no rows.
    """
    spark, rows = measured.sparkSession, measured.drop("shard", "shard_slot")
    key, tok, size, docs = "shard_key", "shard_tokens", "shard_size", rows
    item, cut, at, before = (fresh(docs, f"s_{n}") for n in ("item", "slice", "slot", "before"))
    p_item, p_slice, p_shard, l_key, l_item, l_slices = (fresh(docs, f"s_{n}") for n in ("p_item", "p_slice", "p_shard", "l_key", "l_item", "l_slices"))
    box = [fresh(docs, f"s_box{i}") for i in range(4)]
    groups = rows.groupBy(F.col(key).alias("key")).agg(F.sum(size).alias("bytes"), F.sum(tok).alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = groups.withColumn("bundle", F.pmod("key", F.lit(bundles)).cast("int")).cache()
    total = groups.agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).first()
    share = {d: (total[d] or 0) / shards for d in DIMENSIONS}
    # a group stands alone from 1/64 of a shard on: at most 3 * 64 * shards of them
    heavy = F.lit(False)
    for d in DIMENSIONS:
        heavy = heavy | (F.col(d) > max(1.0, share[d] / 64))
    slices = F.greatest(F.lit(1.0), *[F.ceil(F.col(d) / max(1.0, share[d]) * 4) for d in DIMENSIONS])
    over = F.lit(False)
    for d in DIMENSIONS:
        over = over | (F.col(d) > share[d])
    alone = groups.filter(heavy & (F.col("rows") > 0)).select("key", *DIMENSIONS, F.when(over, slices).otherwise(1).cast("int").alias("slices")).orderBy("key").collect()
    small = groups.filter(~heavy).groupBy("bundle").agg(*[F.sum(d).alias(d) for d in DIMENSIONS]).orderBy("bundle").collect()
    groups.unpersist()

    vectors, names, keys = [], [], []
    for r in small:  # at most `bundles`
        vectors.append((r["bytes"], r["tokens"], r["rows"]))
        names.append((r["bundle"], 0))
    for i, r in enumerate(alone):
        keys.append((r["key"], bundles + i, r["slices"]))
        for s in range(r["slices"]):
            vectors.append(tuple(r[d] // r["slices"] for d in DIMENSIONS))
            names.append((bundles + i, s))
    placed = place_by_dot_product(vectors, shards)
    plan = spark.createDataFrame([(*n, s) for n, s in zip(names, placed, strict=True)], f"{p_item} int, {p_slice} int, {p_shard} int")
    large = spark.createDataFrame(keys, f"{l_key} long, {l_item} int, {l_slices} int")
    # both sides have a fixed bound: bundles, and 3 * 64 * shards large groups in at most 4 slices a share
    rows = rows.join(F.broadcast(large), F.col(key) == F.col(l_key), "left")
    rows = rows.withColumn(item, F.coalesce(l_item, F.pmod(F.col(key), F.lit(bundles)).cast("int")))
    piece = F.pmod(F.xxhash64(column(rows, id_col).cast("long"), F.lit(1)), F.coalesce(l_slices, F.lit(1))).cast("int")
    rows = rows.withColumn(cut, piece).drop(l_key, l_item, l_slices)
    rows = rows.join(F.broadcast(plan), (F.col(item) == F.col(p_item)) & (F.col(cut) == F.col(p_slice)))
    # slots: rows are numbered in cells of at most about a bundle's rows, and the cells of a shard laid end to end
    cell = fresh(docs, "s_cell")
    spread = max(1, bundles // (2 * shards))
    rows = rows.withColumn(cell, F.when(F.col(item) < bundles, 0).otherwise(F.pmod(F.xxhash64(column(rows, id_col).cast("long"), F.lit(2)), F.lit(spread))).cast("int"))
    cells = rows.groupBy(p_shard, item, cut, cell).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(p_shard).orderBy(item, cut, cell).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*[F.col(c).alias(b) for b, c in zip(box, (p_shard, item, cut, cell), strict=True)], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    own = Window.partitionBy(p_shard, item, cut, cell).orderBy(column(rows, id_col).asc_nulls_first(), F.col(key))
    rows = rows.withColumn(at, F.row_number().over(own) - 1)
    on = (F.col(p_shard) == F.col(box[0])) & (F.col(item) == F.col(box[1])) & (F.col(cut) == F.col(box[2])) & (F.col(cell) == F.col(box[3]))
    return rows.join(cells, on).select(*[column(rows, c) for c in docs.columns], F.col(p_shard).alias("shard"), (F.col(at) + F.col(before)).cast("long").alias("shard_slot"))
