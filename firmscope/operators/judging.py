"""What an outside judge is given, batch by batch, and a seam for whoever decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .verdicts import batches

#: Takes a batch's text, returns its answer as JSON text.
Judge = Callable[[str], str]


def batch_texts(queue: DataFrame, size: int = 20) -> DataFrame:
    """part, parts, body: the accounts of each batch as JSON lines, in rank order. Third-party text stays data: it is delimited, never instruction."""
    shown = F.to_json(F.struct("account_id", "name", "website", F.struct("site.title", "site.description", "site.text").alias("site"), "categories", "signals", F.slice("evidence", 1, 10).alias("evidence")))
    b = batches(queue, size).withColumn("line", shown)
    return b.groupBy("part", "parts").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"))


def texts_of(v: Column) -> Column:
    """A VARIANT that is a list or one text, as a list of texts; anything else is none."""
    one = F.try_variant_get(v, "$", "string")
    lone = F.when(F.schema_of_variant(v).startswith("STRING") & (F.coalesce(one, F.lit("")) != ""), F.array(one))
    return F.coalesce(F.try_variant_get(v, "$", "array<string>"), lone, F.array().cast("array<string>"))


#: Fields of a decision with the types that they must have (a text may stand for a list of texts), and values that some are held to.
FIELDS = {
    "account_id": "string", "decision": "string", "reject_reason": "string", "fit": "string", "fit_score": "int", "what_they_do": "string", "why_fit": "array<struct<text:string,context_id:string>>",
    "signals": "array<struct<detail:string,url:string>>", "risks": "array<string>", "contact_role": "string", "draft": "struct<channel:string,subject:string,body:string>",
}
VALUES = {"decision": ["keep", "reject"], "fit": ["strong", "possible", "none"]}
NEEDED = ["account_id", "decision"]


def checked_answers(answers: DataFrame) -> DataFrame:
    """answers: part, answer (JSON text). One row a decision: pos, its fields, and faults: what is wrong with it, or with the whole answer.

    Answers are read as VARIANT, so one that is malformed or of another shape is a row with its fault and not an error of the reader.
    A field that is absent is null; one of another type is null and a fault.
    """
    a = answers.select("part", F.try_parse_json("answer").alias("v")).withColumn("items", F.try_variant_get("v", "$.decisions", "array<variant>"))
    whole = F.when(F.col("v").isNull(), "not JSON").when(F.col("items").isNull(), "no list of decisions")
    rows = a.select((F.col("part") * 100000).alias("base"), whole.alias("whole"), F.posexplode_outer("items").alias("at", "d")).filter(F.col("whole").isNotNull() | F.col("d").isNotNull())
    field = {k: texts_of(F.try_variant_get("d", "$.risks", "variant")) if k == "risks" else F.try_variant_get("d", f"$.{k}", t) for k, t in FIELDS.items()}
    there = lambda k: F.try_variant_get("d", f"$.{k}", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get("d", f"$.{k}", "variant"))
    found = [F.col("whole")]
    for k in FIELDS:
        wrong = there(k) & (F.size(field[k]) == 0) & ~F.schema_of_variant(F.try_variant_get("d", f"$.{k}", "variant")).rlike("^(ARRAY|STRING)") if k == "risks" else there(k) & field[k].isNull()
        found.append(F.when(F.coalesce(wrong, F.lit(False)), f"{k} has another type"))
        if k in VALUES:
            found.append(F.when(~field[k].isin(VALUES[k]), f"{k} is none of {', '.join(VALUES[k])}"))
        if k in NEEDED:
            found.append(F.when(F.col("d").isNotNull() & ~there(k), f"no {k}"))
    return rows.select((F.col("base") + F.coalesce("at", F.lit(0))).alias("pos"), *[c.alias(k) for k, c in field.items()], F.array_compact(F.array(*found)).alias("faults"))


def decided(queue: DataFrame, judge: Judge, rules: str, size: int = 20) -> DataFrame:
    """pos and the decision's fields, from a judge asked once a batch on the driver (a queue is bounded by its search's limit)."""
    spark, rows = queue.sparkSession, []
    for b in batch_texts(queue, size).orderBy("part").collect():
        rows.append((b["part"], judge(f"{rules}\n\nBatch {b['part']} of {b['parts']}\n<records>\n{b['body']}\n</records>")))
    return read_decisions(spark.createDataFrame(rows, "part int, answer string"))


def saved_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions that stand in files, one JSON object a line with its pos, as `checked_answers` gives them."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = checked_answers(lines.select(F.lit(0).alias("part"), F.concat(F.lit('{"decisions":['), F.col("value"), F.lit("]}")).alias("answer")).withColumn("part", F.coalesce(F.try_variant_get(F.try_parse_json("answer"), "$.decisions[0].pos", "int"), F.lit(0))))
    return rows.withColumn("pos", (F.col("pos") / 100000).cast("int"))


def read_decisions(answers: DataFrame) -> DataFrame:
    """answers: part, answer (JSON). pos and the decision's fields; the first fault of any decision raises when it is read."""
    rows = checked_answers(answers)
    fault = F.raise_error(F.concat(F.lit("decision "), F.col("pos").cast("string"), F.lit(": "), F.array_join("faults", ", ")))
    ident = F.when(F.size("faults") > 0, fault).otherwise(F.col("account_id"))
    return rows.select("pos", ident.alias("account_id"), *[k for k in FIELDS if k != "account_id"])
