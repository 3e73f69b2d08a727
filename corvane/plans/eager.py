"""BM25 with scores computed when the index is built.

What a term adds to a chunk's score depends on the corpus alone, so the index stores that number for
each term and chunk, range-partitioned and sorted by term. A query reads the slices of its terms
and adds them up: no text, no length and no document frequency is looked at when it is asked.

Words have two or more letters, digits or underscores and are no stop words; N and the mean length
count every chunk, those without words too. Where no index is stored the scores of
``ranking.bm25_top`` are given instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import ranking
from corvane.operators.relational import lookup, top_k
from corvane.session import exists

K1, B = 1.5, 0.75
WORD = r"[\p{L}\p{N}_]{2,}"
# The English stop words of the library form.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such",
    "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def words(text: Column) -> Column:
    """Lower-case words of two or more word characters without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


def write_scores(docs: DataFrame, root: str, k1: float = K1, b: float = B) -> None:
    """Score slices of ``docs (id, title, text)`` below ``root``.

    ``idf * tf / (tf + k1 * (1 - b + b * length / mean length))`` for each term and chunk, with
    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``; ``terms`` beside them tells how long a slice is.
    """
    spark = docs.sparkSession
    tokenised = docs.select("id", words(F.concat_ws("\n", "title", "text")).alias("_t"))
    counted = tokenised.select("id", F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted.repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id").write.parquet(f"{root}/counts")
    counts = spark.read.parquet(f"{root}/counts")
    # the words of all chunks are counted from the table, so that texts are tokenised once
    n, total = docs.count(), counts.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df.repartitionByRange(parts, "term").sortWithinPartitions("term").write.parquet(f"{root}/terms")
    idf = F.ln(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    share = F.col("tf") / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.lit(total / n if total else 1.0)))
    # a hot term's rows are spread by chunk before they meet its frequency
    weights = spark.read.parquet(f"{root}/terms").select("term", "df", idf.alias("idf"))
    scored = lookup(counts, weights, ["term"], "df", how="inner", spread=["id"]).select("term", "id", (F.col("idf") * share).alias("part"))
    scored.repartitionByRange(parts, "term", "id").sortWithinPartitions("term", "id").write.parquet(f"{root}/scores")


def eager_top(spark: SparkSession, root: str, queries: DataFrame, k: int, docs: DataFrame | None = None) -> DataFrame:
    """``(qid, id, score, rank)``: the ``k`` best chunks of each of ``queries (qid, query)``.

    Only chunks with a positive score are found; a term asked twice counts once. Without an
    index below ``root`` the plain scores over ``docs`` are taken.
    """
    if not exists(spark, f"{root}/scores/_SUCCESS"):
        if docs is None:
            raise FileNotFoundError(f"no scores below {root}, and no chunks to score")
        return ranking.bm25_top(docs, queries, k)
    terms = ranking.query_terms(queries, words(F.col("query"))).select("qid", "term")
    low, high = terms.agg(F.min("term"), F.max("term")).first()
    cut = F.col("term").between(low or "", high or "")
    # how long a slice is says which terms are hot
    sized = terms.join(spark.read.parquet(f"{root}/terms").filter(cut), "term")
    slices = lookup(spark.read.parquet(f"{root}/scores").filter(cut), sized, ["term"], "df", how="inner", spread=["id"])
    scores = slices.groupBy("qid", "id").agg(F.round(F.sum("part"), ranking.SCORE_DIGITS).alias("score")).filter("score > 0")
    return top_k(scores, ["qid"], [F.col("score").desc(), F.col("id")], k)
