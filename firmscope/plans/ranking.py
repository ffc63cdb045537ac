"""Documents as accounts: pattern hits, signals, knock-outs, score and rank in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

PATTERNS = ["license", "copyright", r"\bthe\b"]
QUEUE = 40


def rank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels")
    hits = sum((F.coalesce(F.col("text").rlike(f"(?i){p}"), F.lit(False)).cast("int") for p in PATTERNS), F.lit(0))
    scored = (
        docs.select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("in_region"), hits.alias("hits"))
        .join(labels, "doc_id", "left")
        .select(
            "doc_id", "in_region", "hits",
            F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("sig"),
            (F.coalesce(F.col("toxic"), F.lit(0)) == 0).alias("no_exclude"),
        )
    )
    ranked = scored.withColumn("score", 3 * F.col("sig") + F.least("hits", F.lit(5)) + 2 + F.col("in_region").cast("int"))
    ranked = ranked.withColumn("passed", F.col("in_region") & (F.col("hits") > 0) & F.col("no_exclude"))
    return ranked.filter("passed").orderBy(F.desc("score"), "doc_id").limit(QUEUE).select("doc_id", "hits", "sig", "score")


QUERIES = {"rank_documents": rank_documents}
ORACLE = {
    "rank_documents": f"""
WITH s AS (
  SELECT d.doc_id, coalesce(lang = 'en', false) AS in_region,
         regexp_matches(text, '(?i)license')::INT + regexp_matches(text, '(?i)copyright')::INT
           + regexp_matches(text, '(?i)\\bthe\\b')::INT AS hits,
         coalesce(quality = 1, false)::INT AS sig, coalesce(toxic, 0) = 0 AS no_exclude
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, hits, sig, 3 * sig + least(hits, 5) + 2 + in_region::INT AS score
FROM s WHERE in_region AND hits > 0 AND no_exclude ORDER BY score DESC, doc_id LIMIT {QUEUE}
"""
}
