"""What each filter of a cleaning chain removes alone, together with the others and in every order.

Documents are first counted by their failure flags, so that SQL's CUBE over the flags and the part runs over a few cells
in place of documents. A grouping-set row whose kept flags are all false counts the documents that pass this subset of
filters, with the other flags summed out: the survivors of the subset. A step of an order is a pair of subsets, before
and after its filter; 80 pairs of five filters give the steps of all 120 orders.

Whether a text is a copy hangs on the whole table: rows are summed by id and digest of the text before they are shuffled,
texts never are, and a group of copies is one row for each part and label by the time its smallest id is found.

Edge cases: a null text is an empty one; an empty text has no words, fails A, and is a copy where another text is empty;
a null language is the part of the empty string; a null id is neither smaller than others nor has it smaller ones, so
that its row is never a copy, and it has no label; repeated rows with one id and text are all first ones or all copies;
one id with several texts is judged text by text; of several labels of an id, any quality or toxicity of 1 counts; an
empty table of documents has no part and gives no row, an empty table of labels none that are lost; other columns aren't
read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import settle, table

#: ASCII white space: a fixed value.
SPACES = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDE"


def text_flags(text: Column, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3) -> dict[str, Column]:
    """Failures that a text tells by itself: few words, repeated words, capitals, marks of code or tables. Percentages are of words and code points."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < least_distinct * F.size(words),
        "C": 100 * capitals > most_capitals * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flag_cells(docs: DataFrame, labels: DataFrame, part: str = "lang", doc: str = "doc_id", text: str = "text", flags=text_flags, copies: str = "E") -> DataFrame:
    """part, a boolean for each flag of `flags` and `copies`, n, good, toxic: documents counted by part and failures."""
    whole = F.coalesce(F.col(text), F.lit(""))
    by_text = flags(whole)
    names = [*by_text]
    rows = docs.select(F.col(doc).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole, 256)).alias("digest"), *[c.alias(k) for k, c in by_text.items()])
    rows = rows.groupBy("id", "digest", "part", *names).agg(F.count("*").alias("n"))
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(marked, "id", "left").fillna(False, ["good", "toxic"])
    groups = rows.groupBy("digest", "part", *names, "good", "toxic").agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless")
    )
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("own", F.col("nameless") + F.when(F.col("first.id") == smallest, F.col("first.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.lit(False).alias(copies), F.col("own").alias("n")), F.struct(F.lit(True).alias(copies), (F.col("n") - F.col("own")).alias("n"))))
    split = groups.select("part", *names, "good", "toxic", both.alias("x")).select("part", *names, "good", "toxic", "x.*").filter("n > 0")
    lost = lambda kind: F.sum(F.when(F.col(kind), F.col("n")).otherwise(0)).alias(kind)
    return split.groupBy("part", *names, copies).agg(F.sum("n").alias("total"), lost("good"), lost("toxic")).withColumnRenamed("total", "n")


def survivors(cells: DataFrame, flags: str = LETTERS) -> DataFrame:
    """part, subset, n, good, toxic: documents that pass every filter of the subset, by SQL's CUBE; none are zeros. The first flag is the subset's highest bit."""
    size = len(flags)
    sets = cells.cube("part", *flags).agg(F.grouping_id().alias("rolled"), *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    rolled = lambda k: F.col("rolled").bitwiseAND(1 << (size - 1 - k)) > 0
    passed = reduce(Column.__and__, [rolled(k) | ~F.col(f) for k, f in enumerate(flags)])
    every = (1 << size) - 1
    kept = sets.filter((F.col("rolled") <= every) & passed).select("part", (every - F.col("rolled")).cast("int").alias("subset"), "n", "good", "toxic")
    grid = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("subset"))
    return grid.join(kept, ["part", "subset"], "left").fillna(0, ["n", "good", "toxic"])


def step_audit(cells: DataFrame, flags: str = LETTERS) -> DataFrame:
    """A row for each part, order of all flags and step: what is kept, removed, failing but gone, failing nothing else, lost of
    what labels praise or blame, and removed by the step's filter over all orders. cells is read more than once."""
    size, every = len(flags), (1 << len(flags)) - 1
    bits = {f: 1 << (size - 1 - k) for k, f in enumerate(flags)}
    left = survivors(cells, flags)
    free = F.filter(F.array(*[F.lit(b) for b in bits.values()]), lambda b: F.col("subset").bitwiseAND(b) == 0)
    before = left.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in ("n", "good", "toxic")], F.explode(free).alias("bit"))
    after = left.select("part", F.col("subset").alias("after"), "n", "good", "toxic")
    pairs = before.withColumn("after", F.col("before") + F.col("bit")).join(after, ["part", "after"])
    removed = F.col("n_before") - F.col("n")
    own = Window.partitionBy("part", "bit")
    # orders in which exactly the filters of `before` come earlier
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(size - 1 - k)) for k in range(size)]), (F.bit_count("before") + 1).cast("int"))
    pairs = pairs.select(
        "part", "before", "bit", F.col("n").alias("kept"), removed.alias("removed"), (F.col("good_before") - F.col("good")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic")).alias("toxic_lost"),
        (F.sum(F.when(F.col("before") == 0, removed)).over(own) - removed).alias("redundant"), F.sum(F.when(F.col("before") + F.col("bit") == every, removed)).over(own).alias("unique_fails"), F.sum(removed * orders).over(own).alias("shapley"),
    )
    steps = [("".join(o), k + 1, sum(bits[f] for f in o[:k]), bits[f]) for o in permutations(flags) for k, f in enumerate(o)]
    known = cells.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, bit int")  # as many rows as flags have steps, whatever the data
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return pairs.join(F.broadcast(known), ["before", "bit"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts])


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    cells = flag_cells(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    return step_audit(settle(cells, "cells"))


#: Every document is followed through every order, step by step.
OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > low THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE length(filter_order) < 5 AND NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, filter_order[step:step] AS x, filter_order[1:step - 1] AS earlier FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5)),
g AS (SELECT *, contains(fails, x) AS failing, len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND earlier <> '' AND fails <> '' AS gone FROM f, s),
c AS (SELECT part, filter_order, step, x, count(*) FILTER (NOT gone AND NOT failing) AS kept, count(*) FILTER (NOT gone AND failing) AS removed, count(*) FILTER (gone AND failing) AS redundant,
    count(*) FILTER (fails = x) AS unique_fails, count(*) FILTER (NOT gone AND failing AND good = 1) AS good_lost, count(*) FILTER (NOT gone AND failing AND toxic = 1) AS toxic_lost
  FROM g GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM c
"""
