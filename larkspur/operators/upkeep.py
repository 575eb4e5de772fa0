"""Decisions that keep a store in step with its sources: changes of model, owning folders, sweeps, versions, shadow copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.paths import ancestors
from larkspur.operators.evals import stale_stats
from larkspur.operators.index import remodel_decision

#: The number of tokens that an error message names.
TOKENS_IN_ERROR = r"(\d[\d,]+)\s*tokens"


def model_interlock(targets: DataFrame, markers: DataFrame, model: str) -> DataFrame:
    """targets (collection, ...) with vector_side, whether their vectors are of the model: the marker says so or there is none.

    The keyword side of a target with other vectors is searched all the same.
    """
    marked = markers.select("collection", F.col("model").alias("recorded"))
    return targets.join(marked, "collection", "left").withColumn("vector_side", F.coalesce(F.col("recorded") == model, F.lit(True))).drop("recorded")


def remodel_plan(collections: DataFrame, markers: DataFrame, model: str) -> DataFrame:
    """(collection, kind, decision) of collections (collection, kind, roots_present): keep, backfill, clear or blocked."""
    marked = markers.select("collection", F.col("model").alias("recorded"))
    decision = remodel_decision(F.col("kind"), F.col("recorded"), F.lit(model), F.col("roots_present"))
    return collections.join(marked, "collection", "left").select("collection", "kind", decision.alias("decision"))


def remodel_clear(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows (collection, ...) that stay: those of collections to clear go, so that their files count as new."""
    return rows.join(plan.filter("decision = 'clear'").select("collection"), "collection", "left_anti")


def remodel_record(markers: DataFrame, plan: DataFrame, model: str) -> DataFrame:
    """Markers (collection, model) after the run: those of the plan name the model, but blocked ones keep what they say."""
    done = plan.filter("decision <> 'blocked'").select("collection", F.lit(model).alias("model"))
    return markers.select("collection", "model").join(done.select("collection"), "collection", "left_anti").unionByName(done)


def owning_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """files (abs_path, ...) with the name, path and rel of the first root (name, path, place) that holds them; others go.

    A file given by its owner is wanted whatever the root's excluded or hidden folders are.
    """
    r = roots.select("name", F.col("path").alias("root_path"), "place")
    held = files.withColumn("root_path", F.explode(ancestors(F.col("abs_path")))).join(r, "root_path").select(*files.columns, *r.columns)
    first = F.row_number().over(Window.partitionBy("abs_path").orderBy("place"))
    rel = F.substring("abs_path", F.length("root_path") + 2, F.length("abs_path"))
    return held.withColumn("__n", first).filter("__n = 1").withColumn("rel", rel).drop("__n", "place")


def indexed_documents(chunks: DataFrame) -> DataFrame:
    """(text, file_path) of a documents collection; chunks that don't say their file are left out."""
    return chunks.filter(F.col("file_path").isNotNull()).select("text", "file_path")


def markdown_in_code(chunks: DataFrame) -> DataFrame:
    """Chunks of a code collection that come from .md files, which belong to documents."""
    return chunks.filter(F.col("file_path").endswith(".md"))


def out_of_scope_documents(chunks: DataFrame, roots: DataFrame, on_disk: DataFrame, in_scope: DataFrame) -> DataFrame:
    """Chunks whose file still is on disk under a root of a name that is known and unique, but which no scan takes any more.

    A file that is gone is left to the sweep of deleted sources, an unknown root to its owner.
    """
    unique = roots.groupBy("name").agg(F.count("*").alias("n")).filter("n = 1").select("name")
    known = chunks.withColumn("name", F.substring_index("file_path", "/", 1)).join(F.broadcast(unique), "name", "left_semi")
    return known.join(on_disk.select("file_path"), "file_path", "left_semi").join(in_scope.select("file_path"), "file_path", "left_anti").drop("name")


def current_versions(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(file_path, kind, current_version): of code its root's commit, else the file's digest; of documents the time of change.

    files: file_path, kind, root, sha256, mtime; commits: root, sha.
    """
    joined = files.join(F.broadcast(commits.select("root", "sha")), "root", "left")  # one row for each configured folder
    return joined.select("file_path", "kind", F.when(F.col("kind") == "code", F.coalesce("sha", "sha256")).otherwise(F.col("mtime").cast("string")).alias("current_version"))


def collection_stale_rates(chunks: DataFrame, versions: DataFrame, known: DataFrame) -> DataFrame:
    """(project, kind, fresh, stale, unknown, rate) of every known project (project, kind); without chunks 0 and a null rate.

    A source without a current version is unknown, which doesn't count in the rate.
    """
    joined = chunks.select("project", "kind", "file_path", "version_id").join(versions, ["file_path", "kind"], "left")
    stats = known.select("project", "kind").join(stale_stats(joined, ["project", "kind"]), ["project", "kind"], "left")
    return stats.fillna(0, ["fresh", "stale", "unknown"])


def shadow_missing(source: DataFrame, shadow: DataFrame) -> DataFrame:
    """Rows of a collection (id, text, ...) that its copy under another model lacks; rows without text are never copied."""
    return source.filter("text IS NOT NULL AND text <> ''").join(shadow.select("id"), "id", "left_anti")


def embeddable_queries(queries: DataFrame, cache: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """(text, model): what of queries (text, model) has to be embedded: each once, unless the cache (text, model, at) has it not older than that."""
    fresh = cache.filter(F.unix_timestamp(now) - F.unix_timestamp("at") < seconds)
    return queries.select("text", "model").distinct().join(fresh.select("text", "model"), ["text", "model"], "left_anti")


def tokens_in_error(message: Column) -> Column:
    """The number of tokens that a provider's message names, else null."""
    return F.nullif(F.regexp_replace(F.regexp_extract(message, TOKENS_IN_ERROR, 1), ",", ""), F.lit("")).try_cast("long")
