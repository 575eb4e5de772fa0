"""A bi-temporal fact store: chains of (subject, predicate), each with versions of its object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = 0


def apply_facts(facts: DataFrame, order: list[str], chain: str = "chain_key", object_: str = "object", at: str = "valid_from", current: DataFrame | None = None) -> DataFrame:
    """Every fact with its action INSERT, NOOP or SUPERSEDE, its version, and the validity of rows that count.

    The object that holds is always the previous fact's, so that lag() decides. current (chain, object, at, version):
    facts that hold already; they come before all others of their chain and aren't returned.
    """
    new = facts.withColumns({"__old": F.lit(0), "__version": F.lit(0)})
    if current is not None:
        seed = current.select(F.col(chain), F.col(object_), F.col(at), F.col("version").alias("__version"), F.lit(1).alias("__old"))
        new = new.unionByName(seed, allowMissingColumns=True)
    w = Window.partitionBy(chain).orderBy(F.desc("__old"), *order)
    previous = F.lag(object_).over(w)
    action = F.when(F.col("__old") == 1, "OLD").when(previous.isNull(), "INSERT").when(previous == F.col(object_), "NOOP").otherwise("SUPERSEDE")
    acted = new.withColumn("action", action)
    counts = F.when(F.col("action").isin("INSERT", "SUPERSEDE"), 1).otherwise(F.col("__version"))
    acted = acted.withColumn("version", F.sum(counts).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    after = Window.partitionBy(chain).orderBy(F.desc("__old"), *order).rowsBetween(1, Window.unboundedFollowing)
    ends = F.first(F.when(F.col("action") == "SUPERSEDE", F.col(at)), ignorenulls=True).over(after)
    held = F.col("action") != "NOOP"
    out = acted.withColumns({"invalid_at": F.when(held, F.coalesce(ends, F.lit(OPEN).cast(facts.schema[at].dataType))), "is_current": held & ends.isNull()})
    return out.filter("__old = 0").drop("__old", "__version")


def repaired(rows: DataFrame, now: Column, chain: str = "chain_key") -> DataFrame:
    """Of several current rows of a chain, the one with the highest version stays current; the others are closed now."""
    first = F.row_number().over(Window.partitionBy(chain, "is_current").orderBy(F.desc("version"), "fact_id"))
    extra = F.col("is_current") & (F.col("__n") > 1)
    return rows.withColumn("__n", first).withColumns({"invalid_at": F.when(extra, now).otherwise(F.col("invalid_at")), "is_current": F.col("is_current") & ~extra}).drop("__n")


def current_facts(rows: DataFrame, chain: str = "chain_key") -> DataFrame:
    """The current row of every chain, the highest version where there are several."""
    best = Window.partitionBy(chain).orderBy(F.desc("version"), "fact_id")
    return rows.filter("is_current").withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def as_of(rows: DataFrame, when: Column) -> DataFrame:
    """Rows that held at a time."""
    return rows.filter((F.col("valid_from") <= when) & ((F.col("invalid_at") == OPEN) | (F.col("invalid_at") > when)))
