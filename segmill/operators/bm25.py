"""BM25 over documents or an index: disjunctive queries, scored in one batch.

A document's score for a query is the sum over the query's terms of

    ln(1 + (N - df + 0.5) / (df + 0.5)) * tf / (tf + K1 * (1 - B + B * dl / avgdl))

dl is the length after its round trip through a norm byte, avgdl the exact mean
over all documents.  A term that a query has twice counts twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmill.errors import SegmentError
from segmill.functions.text import norm_length, tokens
from segmill.operators.postings import spread
from segmill.session import cut

K1, B = 1.2, 0.75
#: Terms of all queries together up to which they are looked up in a hash set of the plan; more are joined.
PLAN_TERMS = 1000


def query_frame(spark, queries: dict[str, Sequence[str]]) -> DataFrame:
    """(qid, term, weight): weight is how often the query has the term."""
    rows = [(q, t, list(ts).count(t)) for q, ts in queries.items() for t in dict.fromkeys(ts)]
    return spark.createDataFrame(rows, "qid string, term string, weight int")


def _idf(n, df):
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _part(tf, dl, mean):
    return tf / (tf + K1 * (1 - B + B * dl / mean))


def scores(docs: DataFrame, queries: dict[str, Sequence[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(qid, doc_id, score) of every document that has a term of the query, from texts in one pass.

    A document keeps only its length and the terms that are asked for before
    anything is shuffled.  That small relation is read twice, for the statistics
    and for the scores, and written to the shared folder in between.
    """
    wanted = sorted({t for ts in queries.values() for t in ts})
    spark = docs.sparkSession
    asked = query_frame(spark, queries)
    own = spread(docs, [key], text).select(F.col(key).alias("doc_id"), tokens(text).alias("t")).select("doc_id", F.greatest(F.size("t").cast("long"), F.lit(0)).alias("n"), "t")
    if len(wanted) <= PLAN_TERMS:
        own = own.withColumn("t", F.filter("t", lambda t: t.isin(wanted)))
    found = cut(own.withColumn("t", F.coalesce("t", F.array().cast("array<string>"))), "bm25")
    stats = found.agg(F.count("*").cast("double").alias("nd"), (F.sum("n").cast("double") / F.count("*")).alias("mean"))
    each = found.where(F.size("t") > 0).select("doc_id", norm_length("n").cast("double").alias("dl"), F.explode("t").alias("term"))
    if len(wanted) > PLAN_TERMS:
        each = each.join(asked.select("term").distinct(), "term", "left_semi")
    tf = each.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("freq"))
    df = tf.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    return _scored(tf, df, stats, asked)


def _scored(tf: DataFrame, df: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """Queries and frequencies are broadcast where Spark finds them small; statistics are one row."""
    asked = queries.join(df, "term").crossJoin(F.broadcast(stats)).select("qid", "term", "mean", (F.col("weight") * _idf(F.col("nd"), F.col("df"))).alias("idf"))
    return tf.join(asked, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("idf") * _part(F.col("freq"), F.col("dl"), F.col("mean"))).alias("score"))


def scores_of_index(postings: DataFrame, lengths: DataFrame, queries: dict[str, Sequence[str]]) -> DataFrame:
    """(qid, doc_id, score) from postings (doc_id, term, freq) and lengths (doc_id, length).

    Postings that are stored in the order of terms, as Store.index() writes
    them, are read for the asked terms alone.
    """
    asked = query_frame(postings.sparkSession, queries)
    terms = sorted({t for ts in queries.values() for t in ts})
    picked = postings.where(F.col("term").isin(terms)) if len(terms) <= PLAN_TERMS else postings.join(asked.select("term").distinct(), "term", "left_semi")
    stats = lengths.agg(F.count("*").cast("double").alias("nd"), (F.sum("length").cast("double") / F.count("*")).alias("mean"))
    df = picked.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    tf = picked.join(lengths.select("doc_id", norm_length("length").cast("double").alias("dl")), "doc_id")
    return _scored(tf, df, stats, asked)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(qid, rank, doc_id, score): the k best documents of each query; scores equal to 9 places go by document."""
    if k < 1:
        raise SegmentError("k must be at least 1")
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, queries: dict[str, Sequence[str]], k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    return top_k(scores(docs, queries, key, text), k)
