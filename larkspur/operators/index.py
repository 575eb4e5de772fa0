"""Keeping an index up to date: differences, sweeps, batches, caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.paths import prefixes_of
from larkspur.sources.batches import small_batches

BATCH_TOKENS, BATCH_ITEMS = 80_000, 128


def last_of_each(rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key, the last by order. Without order no key may have two rows: which one counts couldn't be told, so that is an error."""
    w = Window.partitionBy(*keys)
    if order is None:
        numbered = rows.withColumn("__n", F.count("*").over(w))
        twice = F.raise_error(F.lit(f"rows with equal {', '.join(keys)} need an order"))
        return numbered.filter(F.when(F.col("__n") == 1, True).otherwise(twice.cast("boolean"))).drop("__n")
    return rows.withColumn("__n", F.row_number().over(w.orderBy(F.desc(order)))).filter("__n = 1").drop("__n")


def upsert(target: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """target with new's rows in place of those with equal keys; of several new rows of a key the last by order counts."""
    last = last_of_each(new, keys, order)
    return target.join(new, keys, "left_anti").unionByName(last if order in (None, *target.columns) else last.drop(order))


def manifest_diff(files: DataFrame, manifest: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """(path, state): new, changed, same or deleted."""
    f, m = files.select(F.col(path).alias("path"), F.col(digest).alias("now")), manifest.select(F.col(path).alias("path"), F.col(digest).alias("was"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return f.join(m, "path", "full").select("path", state.alias("state"))


def cache_split(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks (model, content_hash) with their cached embedding or null, and the distinct hashes to embed."""
    keys = ["model", "content_hash"]
    return chunks.join(cache, keys, "left"), chunks.select(*keys).distinct().join(cache, keys, "left_anti")


def stale_chunks(stored: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Stored chunks of files that were indexed now, which the new chunks don't have."""
    return stored.join(files.select("file_path"), "file_path", "left_semi").join(fresh.select("id"), "id", "left_anti")


def only_left(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    return left.join(right, key, "left_anti")


def complete_files(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of which every chunk was stored; expected: file_path, n. A file of no chunks is complete."""
    n = stored.groupBy("file_path").agg(F.countDistinct("id").alias("got"))
    return expected.join(n, "file_path", "left").filter(F.coalesce("got", F.lit(0)) == F.col("n")).select("file_path")


def safe_roots(roots: DataFrame) -> DataFrame:
    """Roots (name, path) that exist and whose name no other has."""
    w = Window.partitionBy("name")
    return roots.filter("exists").withColumn("__n", F.count("*").over(w)).filter("__n = 1").drop("__n")


def deleted_sources(chunks: DataFrame, roots: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks whose root is known and safe and whose file is gone. An unknown root keeps its chunks."""
    known = chunks.withColumn("name", F.substring_index("file_path", "/", 1)).join(safe_roots(roots).select("name"), "name", "left_semi")
    return known.join(files.select("file_path"), "file_path", "left_anti").drop("name")


def orphan_documents(chunks: DataFrame, root: str, present: DataFrame) -> DataFrame:
    """Chunks under a root whose path is not present; none where nothing is, as an empty root is more likely unmounted."""
    if present.isEmpty():
        return chunks.limit(0)
    return chunks.filter(F.col("file_path").startswith(f"{root}/")).join(present.select("file_path"), "file_path", "left_anti")


def under(path: Column, root: str, excluded: list[str]) -> Column:
    """Whether a path lies in an excluded folder; the closing slash keeps Lib apart from Library."""
    found = F.lit(False)
    for folder in excluded:
        found = found | path.startswith(f"{root}/{folder.strip('/')}/")
    return found


def out_of_scope(manifest: DataFrame, root: str, in_scope: DataFrame, extensions: list[str]) -> DataFrame:
    """Manifest paths under a root with code extensions that no scan has any more."""
    ends = F.concat(F.lit("."), F.substring_index("path", ".", -1))
    return manifest.filter(F.col("path").startswith(f"{root.rstrip('/')}/") & ends.isin(extensions)).join(in_scope.select("path"), "path", "left_anti")


def not_indexed(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources of which the collection has no chunk; their manifest rows are to be cleared."""
    return sources.join(chunks.select("file_path"), "file_path", "left_anti")


def changed_models(collections: DataFrame, markers: DataFrame) -> DataFrame:
    """Collections (collection, model, n) with rows whose marker is another model."""
    m = markers.select("collection", F.col("model").alias("recorded"))
    return collections.join(m, "collection").filter((F.col("recorded") != F.col("model")) & (F.col("n") > 0))


def remodel_decision(kind: Column, recorded: Column, model: Column, roots_present: Column) -> Column:
    """What a change of model asks for: keep, backfill (mark alone), clear, or blocked where a root is missing.

    A collection without a marker has unknown vectors: documents count as changed, code is marked as it is.
    """
    change = F.when(recorded.isNull() & (kind == "code"), "backfill").when(recorded.isNull() | (recorded != model), "clear").otherwise("keep")
    return F.when((change == "clear") & ~roots_present, "blocked").otherwise(change)


def route_manifest(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, sha256, project): the first project, in order, of which a root's path begins the key; else _orphaned."""
    r = roots.select("project", "root", "place")
    begun = entries.select("path", "sha256", F.explode_outer(prefixes_of(F.col("path"), r, "root")).alias("root"))
    # a beginning that is no root has no place, which min_by leaves out
    return begun.join(r, "root", "left").groupBy("path", "sha256").agg(F.coalesce(F.min_by("project", "place"), F.lit("_orphaned")).alias("project"))


def estimate_tokens(length: Column, ratio: Column | None = None) -> Column:
    floor = F.floor(length / 2).cast("long")
    return floor if ratio is None else F.coalesce(F.greatest(floor, F.floor(length / ratio).cast("long")), floor)


def calibrated(batches: DataFrame, group: str, order: str) -> DataFrame:
    """(group, ratio): characters a token after all batches (chars, tokens) in order, as a moving average of 0.8 and 0.2."""
    rows = F.sort_array(F.collect_list(F.struct(order, "chars", "tokens")))
    fold = F.aggregate("rows", F.lit(None).cast("double"), lambda r, x: F.when(x["tokens"] <= 0, r).otherwise(F.when(r.isNull(), x["chars"] / x["tokens"]).otherwise(0.8 * r + 0.2 * x["chars"] / x["tokens"])))
    return batches.groupBy(group).agg(rows.alias("rows")).select(group, fold.alias("ratio"))


def packed(chunks: DataFrame, group: str, order: list[str], text: str = "text", most_tokens: int = BATCH_TOKENS, most_items: int = BATCH_ITEMS, keep_text: bool = True) -> DataFrame:
    """Adds batch and tokens: chunks of a group in order, a new batch where one would have too many tokens or items.

    A chunk of more tokens than a batch has room for is cut. Groups stream through sorted, so that a group of any size
    needs the state of one batch alone. Without keep_text the texts are left behind before anything is shuffled.
    """
    small_batches(chunks.sparkSession)
    longest = most_tokens * 2

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, batch, used, items = object(), 0, 0, 0
        for frame in frames:
            out = []
            for key, tokens in zip(frame[group], frame["tokens"], strict=True):
                if key != last:
                    last, batch, used, items = key, 0, 0, 0
                elif used + tokens > most_tokens or items >= most_items:
                    batch, used, items = batch + 1, 0, 0
                used, items = used + tokens, items + 1
                out.append(batch)
            yield frame.assign(batch=pd.Series(out, dtype="int64", index=frame.index))

    cut = chunks.withColumn(text, F.substring(F.col(text), 1, longest)).withColumn("tokens", estimate_tokens(F.length(text)))
    cut = cut if keep_text else cut.drop(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", batch long"
    return cut.repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def status(chunks: DataFrame) -> DataFrame:
    """(project, kind, n) with subtotals and a total, whose keys are null."""
    return chunks.rollup("project", "kind").agg(F.count("*").alias("n"))


def tracked_files(manifest: DataFrame) -> DataFrame:
    """One row (n): manifest entries of all projects, whichever a status is asked for; those named with _ are no projects."""
    return manifest.filter(~F.col("project").startswith("_")).agg(F.count("*").alias("n"))


def top_paths(paths: DataFrame, parts: int = 2, n: int = 15) -> DataFrame:
    return paths.groupBy(F.substring_index("path", "/", parts).alias("folder")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "folder").limit(n)


def evenly(df: DataFrame, n: int, order: str) -> DataFrame:
    """Every (rows // n)-th row in order, n at most."""
    from pyspark.sql.types import LongType

    total = df.count()
    step = max(1, total // n)
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id())
    sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}  # one row for each task
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    offset = F.udf(lambda p: start.get(p, 0), LongType())
    inside = F.row_number().over(Window.partitionBy("__p").orderBy(order))
    return ranged.withColumn("__n", inside + offset("__p") - 1).filter((F.col("__n") % step == 0) & (F.col("__n") < step * n)).drop("__n", "__p")
