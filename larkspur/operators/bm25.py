"""Keyword search: an inverted index in tables, and BM25 over many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import terms

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
PLACES = 9


def postings(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf)."""
    return docs.select(F.col(id_).alias("id"), F.explode(terms(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, dl): terms of every document, with those that have none."""
    return docs.select(F.col(id_).alias("id"), F.size(terms(F.col(text))).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl), over the whole index whatever a query filters."""
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "text") -> DataFrame:
    """(query, term, times): terms a query has twice count twice."""
    return queries.select(F.col(query).alias("query_id"), F.explode(terms(F.col(text))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


#: Different query terms that are sent to every task; more are joined by a shuffle.
MOST_TERMS = 500_000


def asked_postings(docs: DataFrame, wanted: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, dl, term, tf) of the wanted terms alone: a document is cut into terms once, with its length beside them."""
    names = wanted.select("term").distinct()
    small = names.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    # an inner explode would be preceded by a filter on its array, which cuts every document a second time
    whole = docs.select(F.col(id_).alias("id"), terms(F.col(text)).alias("ts")).withColumn("dl", F.size("ts").cast("long"))
    cut = whole.select("id", "dl", F.explode_outer("ts").alias("term"))
    return cut.join(F.broadcast(names) if small else names, "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def scores(asked: DataFrame, stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, id, score) of every document with a term of the query, rounded to 9 places so that ties are ties.

    asked: postings of the wanted terms with lengths, which document frequencies come from too; stats: corpus_stats().
    """
    # needs tf, so that this branch has the same shuffle as the other, which is then done once
    frequency = asked.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"))
    weight = wanted.join(frequency, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "avgdl", (F.col("times") * idf(F.col("n_docs"), F.col("df"))).alias("weight"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / norm
    return asked.join(weight, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), PLACES).alias("score"))


#: The older scorer that benchmarks compare with: its constants, and the share of the mean that stands for a negative idf.
OKAPI_K1, OKAPI_B, OKAPI_FLOOR = 1.5, 0.75, 0.25
#: Its sums reach some dozens, so that the last of 9 places would be noise.
OKAPI_PLACES = 6


def okapi_raw(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def okapi_idf(raw: Column, mean: Column) -> Column:
    return F.when(raw < 0, OKAPI_FLOOR * mean).otherwise(raw)


def okapi_scores(docs: DataFrame, queries: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(query_id, id, score) above 0 by BM25 Okapi, whose idf is that of the whole vocabulary: below 0 a share of the mean idf."""
    post = docs.select(F.col(id_).alias("id"), terms(F.col(text)).alias("ts")).select("id", F.size("ts").cast("long").alias("dl"), F.explode("ts").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    stats = F.broadcast(corpus_stats(doc_lengths(docs, id_, text)))  # one row
    raw = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(stats).withColumn("raw", okapi_raw(F.col("n_docs"), F.col("df")))
    mean = F.broadcast(raw.agg(F.avg("raw").alias("mean")))  # one row
    weight = raw.crossJoin(mean).select("term", "avgdl", okapi_idf(F.col("raw"), F.col("mean")).alias("idf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (OKAPI_K1 + 1) / (F.col("tf") + OKAPI_K1 * (1 - OKAPI_B + OKAPI_B * F.col("dl") / F.col("avgdl")))
    scored = query_terms(queries).join(weight, "term").join(post, "term").groupBy("query_id", "id").agg(F.round(F.sum(part), OKAPI_PLACES).alias("score"))
    return scored.filter(F.col("score") > 0)


def top(scored: DataFrame, n: int) -> DataFrame:
    """Adds rank from 1; ties by id. Spark cuts to n per task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def path_matches(path: Column, wanted: str, like: bool = False) -> Column:
    """Literal containment, or with like=True the wildcards and case folding of SQL's LIKE. A null path never matches."""
    return F.coalesce(path.ilike(f"%{wanted}%") if like else path.contains(wanted), F.lit(False))


def search(docs: DataFrame, queries: DataFrame, n: int = 5, id_: str = "id", text: str = "text", query: str = "query_id", query_text: str = "text", path: str | None = None, path_filter: str | None = None, like: bool = False) -> DataFrame:
    """(query_id, id, score, rank). The path filter comes after the scores and before the cut."""
    wanted = query_terms(queries, query, query_text)
    scored = scores(asked_postings(docs, wanted, id_, text), corpus_stats(doc_lengths(docs, id_, text)), wanted)
    if path_filter is not None:
        paths = docs.filter(path_matches(F.col(path), path_filter, like)).select(F.col(id_).alias("id"))
        scored = scored.join(paths, "id", "left_semi")
    return top(scored, n)
