"""Full-text scores, rank fusion, collapse of clusters, and ranking metrics, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


#: Asked terms up to which words are filtered where they are found.
FEW_TERMS = 500


def term_scores(docs: DataFrame, queries: DataFrame, doc: str, text: str) -> DataFrame:
    """(query, doc, score): sum over a query's terms of ln(1 + tf) * ln(1 + N / df). queries has query and term.

    Postings of asked terms only: the words are joined to the query terms before they are counted. The measure is this
    library's own; it claims no parity with another engine's ranking.
    """
    asked = queries.select("query", "term").distinct()
    terms = [r.term for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    words = tokens(F.col(text))
    if len(terms) <= FEW_TERMS:  # most words go before they become rows; with more terms the join below takes them out
        words = F.filter(words, lambda w: w.isin(terms))
    words = docs.select(F.col(doc).alias("doc"), F.explode(words).alias("term"))
    counts = words.join(asked.select("term").distinct(), "term").groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"))
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.count(F.lit(1)).alias("n"))
    scored = counts.join(df, "term").join(F.broadcast(total)).join(asked, "term")
    return scored.groupBy("query", "doc").agg(F.sum(F.log1p("tf") * F.log1p(F.col("n") / F.col("df"))).alias("score"))


def ranked(df: DataFrame, query: str, score: Column, tie: str, k: int | None = None) -> DataFrame:
    """Adds rank within each query by falling score, NaN last, ties by id; the first k if asked."""
    clean = F.nanvl(score, F.lit(float("-inf")))
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(clean), tie)))
    return out.where(F.col("rank") <= k) if k else out


def fused(channels: list[DataFrame], query: str, item: str, k: int = 60) -> DataFrame:
    """(query, item, score): reciprocal-rank fusion of ranked channels, sum of 1 / (k + rank)."""
    rows = channels[0].select(query, item, "rank")
    for other in channels[1:]:
        rows = rows.unionByName(other.select(query, item, "rank"))
    return rows.groupBy(query, item).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def collapsed(df: DataFrame, query: str, item: str, cluster: Column, posted: str, k: int) -> DataFrame:
    """One row per cluster, its earliest posted member in that member's own position; ranked anew and cut to k."""
    rows = df.withColumn("__c", cluster)
    first = F.row_number().over(Window.partitionBy(query, "__c").orderBy(F.asc_nulls_last(posted), item))
    kept = rows.withColumn("__r", first).where("__r = 1").drop("__r", "__c")
    again = F.row_number().over(Window.partitionBy(query).orderBy("rank"))
    return kept.withColumn("rank", again).where(F.col("rank") <= k)


def ranking_metrics(df: DataFrame, query: str, grade: str, k: int, good: int = 2) -> DataFrame:
    """(query, ndcg, mrr, precision, top): df has a rank and a grade for each query's results."""
    gain = lambda position: (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(position + 1)
    ideal = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(grade), "rank"))
    rows = df.withColumn("__i", ideal)
    sums = rows.groupBy(query).agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("rank")))).alias("dcg"),
        F.sum(F.when(F.col("__i") <= k, gain(F.col("__i")))).alias("best"),
        F.min(F.when(F.col(grade) >= good, F.col("rank"))).alias("first"),
        F.sum(F.when((F.col("rank") <= 5) & (F.col(grade) >= good), 1).otherwise(0)).alias("hits"),
        F.avg(F.when(F.col("rank") <= k, F.col(grade))).alias("top"),
    )
    return sums.select(query, F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("hits") / 5).alias("precision"), "top")
