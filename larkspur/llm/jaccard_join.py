"""Exact self-join of texts by the Jaccard similarity of their word shingles, with set-relation skipping.

1. Texts with equal sets become one node, the smallest id among them.
2. Shingles have one global order: those met often last, by counts over all different texts, the rest by hash. A set's first
   shingles in that order (its prefix) go into index lists, one for each shingle, sorted by position. Two sets at or
   above the threshold have a shingle in both prefixes.
3. A list's head is the set with the earliest position in it. Every set is compared with the head that it meets in
   most lists, whole texts against whole texts, and linked sets become one component.
4. Answers of a set follow from those of the linked head: lists, and pairs within a list, whose sets are in one
   component already are skipped. The other lists are cut into blocks of about equal sizes before they are paired: an
   entry's own size and its position, which says how many shingles can still be common, bound the sizes of larger
   sets that reach the threshold with it, and only the blocks in these bounds are joined to it. What remains after
   the other's position is compared whole, and components that a pair links become one.

Before texts are moved for a comparison, a bound drops pairs: of both sets a bit map has the parity of the shingles that
fall on each bit, and no two maps differ in more bits than their sets differ in shingles.

So every pair at or above the threshold is compared, or both its sets are in one component without it. Lists of very
frequent shingles are split by salt for step 3, and their heads meet in a second step; a salted entry stays if it is
alone under its salt, as others of its shingle have other salts. The join of step 4 is left to Spark's skew splitting.
Nothing is dropped or capped: the list of frequent shingles, which is bounded, only orders.

Edge cases: a null, empty or blank text has an empty set, no link and itself as component; fewer words than a shingle
has are one shingle; rows with equal ids and texts are one node and one row each in the result; rows of equal id and
different texts are linked if any of those texts is; a null id joins no other row, its component is the smallest id
of an equal set or null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import components, semi_by_id, settle, table
from larkspur.llm.shingles import WORDS, mix, shingle_sets

#: Of at most so many frequent shingles the order follows their counts; 16 bytes each on every worker.
FREQUENT = 1 << 18
#: Shingles counted together before they are shuffled, and the least count in such a lot that is told on.
LOT, LEAST = 2_000_000, 2
#: Bits of a set's map of parities.
BITS = 1024
#: Entries of an index list beyond which it is split.
LONG_LIST = 100_000
#: Sizes in one block of a list differ by this factor at most.
BLOCK = 1.1


def required(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection of sets of n and m for 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """id, n, f1, f2, bits: size of the set, its fingerprint and its map of parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2 = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            bits = np.zeros((batch.num_rows, BITS // 8), np.uint8)
            for i, s in shingle_sets(batch.column(1), words):
                bits[i] = np.packbits((np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(bool))
                n[i], f1[i], f2[i] = len(s), mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(bits.view(np.int64).ravel()), BITS // 64).cast(pa.list_(pa.int64()))], ["id", "n", "f1", "f2", "bits"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, f1 long, f2 long, bits array<long>")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose maps of parities don't rule out that they reach the threshold."""
    named = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = pairs.join(named("a"), "a").join(named("b"), "b")
    return both.filter(differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b").distinct()


def _frequent(docs: DataFrame, words: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles in most texts, counted over all of them in lots, of which only those count where a shingle is met LEAST times; at most `most`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(lot: list[np.ndarray]) -> pa.RecordBatch:
            x, n = np.unique(np.concatenate(lot), return_counts=True)
            often = n >= LEAST
            return pa.RecordBatch.from_arrays([pa.array(x[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["shingle", "n"])

        lot, held = [], 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), words):
                lot.append(s)
                held += len(s)
                if held > LOT:
                    yield told(lot)
                    lot, held = [], 0
        if lot:
            yield told(lot)

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = settle(counts.withColumn("level", F.floor(8 * F.log2("n")).cast("int")), "counts")
    # whole levels of counts from the top, as many as fit: no task sends more than it has of these
    least, total = 1 << 30, 0
    for level, size in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most some hundred levels
        total += size
        if total > most:
            break
        least = level
    top = counts.filter(F.col("level") >= least).select("shingle", "n").toArrow()  # at most `most` rows of 16 bytes
    shingle, n = top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def _prefixes(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int, words: int, long_list: int) -> DataFrame:
    """shingle, salt, id, n, pos of every set's prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                rows, shingles, sizes, places, salts = [], [], [], [], []
                for i, s in shingle_sets(part.column(1), words):
                    n = len(s)
                    if not n:
                        continue
                    often = np.zeros(n, np.int64)
                    if len(known):
                        k = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        often = np.where(known[k] == s, count[k], 0)
                    # the least intersection with any set is that with one of the least size
                    keep = n - -(-percent * n // 100) + 1
                    order = np.argsort(often, kind="stable")[:keep]  # s is sorted by hash
                    rows.append(np.full(keep, i))
                    shingles.append(s[order])
                    sizes.append(np.full(keep, n))
                    places.append(np.arange(keep))
                    salts.append(np.where(often[order] > long_list, 1 + (int(mix(s).sum(dtype=np.uint64)) >> 1) % (1 + often[order] // long_list), 0))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(salts).astype(np.int32)), part.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(places).astype(np.int32))], ["shingle", "salt", "id", "n", "pos"])

    return docs.mapInArrow(run, f"shingle long, salt int, id {docs.schema['id'].dataType.simpleString()}, n int, pos int")


def _lists(entries: DataFrame) -> DataFrame:
    """The entries of lists of two or more, with the head of their list. A list streams through; only its last entry is held.

    A salted entry stays even if it is alone, as its own head: its company may be under other salts.
    """
    kind = entries.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "salt", "id", "n", "pos"]
        held, head, told = None, None, False  # the last entry, its list's head, whether it is known to have company
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            shingle, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = len(shingle)
            new = np.ones(n, bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (salt[1:] != salt[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            alone = new & np.append(new[1:], False) & (salt == 0)
            if told:
                alone[0] = False
            out = ~alone
            out[-1] = False  # held for the next batch
            where = np.flatnonzero(out)
            heads = batch.select(["id", "n"]).take(pa.array(start[where]))
            head_id, head_n = heads.column(0).to_pylist() if head is not None else heads.column(0), heads.column(1).to_numpy()
            if head is not None:
                carried = start[where] == 0
                head_id = pa.array([head[0] if c else h for c, h in zip(carried, head_id, strict=True)], batch.column(2).type)
                head_n = np.where(carried, head[1], head_n)
            if len(where):
                rows = batch.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([*rows.columns, head_id, pa.array(head_n.astype(np.int32))], [*names, "head", "head_n"])
            first = int(start[-1])
            if not (first == 0 and head is not None):
                head = (batch.column(2)[first].as_py(), int(batch.column(3)[first].as_py()))
            told = first < n - 1 or (first == 0 and told)
            held = batch.slice(n - 1, 1)
        if held is not None and (told or held.column(1)[0].as_py()):
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([head[0]], held.column(2).type), pa.array([head[1]], pa.int32())], [*names, "head", "head_n"])

    ordered = entries.repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "pos", "id")
    return ordered.mapInArrow(run, f"shingle long, salt int, id {kind.simpleString()}, n int, pos int, head {kind.simpleString()}, head_n int")


def _linked(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) at or above the threshold, by their whole texts."""
    kind = docs.schema["id"].dataType.simpleString()
    ends = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = semi_by_id(docs, settle(ends, "ends"), "id", "id")
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict = {}  # the set of the last b, which many pairs share
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                b_ids, keep = part.column(1).to_pylist(), []
                fresh = [i for i, b in enumerate(b_ids) if b not in last and (i == 0 or b != b_ids[i - 1])]
                sets = {b_ids[fresh[i]]: s for i, s in shingle_sets(part.column(3).take(pa.array(fresh, pa.int64())), words)} | last
                for i, s in shingle_sets(part.column(2), words):
                    t = sets[b_ids[i]]
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        keep.append(i)
                last = {b_ids[-1]: sets[b_ids[-1]]}
                yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(run, f"a {kind}, b {kind}")


def jaccard_components(docs: DataFrame, doc: str = "doc_id", text: str = "text", percent: int = 80, words: int = WORDS, most_frequent: int = FREQUENT, long_list: int = LONG_LIST) -> DataFrame:
    """doc, n_shingles and component_id, the smallest doc reachable by links of at least `percent` per cent similarity."""
    docs = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"))
    sets = settle(_sets(docs, words), "sets")
    full = sets.filter("n > 0")
    nodes = settle(full.groupBy("f1", "f2", "n").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "nodes")
    copies = full.join(nodes.filter("copies > 1"), ["f1", "f2", "n"]).filter("id <> node").select("id").union(sets.filter("n = 0").select("id"))
    # an id that is a copy here and a node there, by another text, stays
    copies = settle(copies.distinct().join(nodes.select(F.col("node").alias("id")), "id", "left_anti"), "copies")
    own = semi_by_id(docs.filter(F.col("id").isNotNull()), copies, "id", "id", keep=False)

    entries = settle(_lists(_prefixes(own, _frequent(own, words, most_frequent), percent, words, long_list)), "lists")
    near = (F.least("n", "head_n") * 100 >= F.greatest("n", "head_n") * percent) & (F.col("id") != F.col("head"))
    met = entries.filter(near).groupBy("id", "head").agg(F.count("*").alias("lists"))
    pairs = met.groupBy("id").agg(F.max_by("head", F.struct("lists", "head")).alias("head")).select(F.col("id").alias("a"), F.col("head").alias("b"))
    heads = entries.filter("salt > 0").select("shingle", "head").distinct()
    tops = heads.groupBy("shingle").agg(F.min("head").alias("top"))
    pairs = settle(pairs.union(heads.join(tops, "shingle").filter("head <> top").select("head", "top")).distinct(), "pairs")
    links = settle(_linked(settle(_possible(pairs, full, percent), "possible"), own, percent, words), "links")
    group = components(links)

    labelled = entries.select("shingle", "id", "n", "pos").join(group.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = settle(labelled, "labelled")
    mixed = labelled.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle")
    left = settle(labelled.join(mixed, "shingle", "left_semi"), "mixed")
    block = lambda n: F.floor(F.log(n) / math.log(BLOCK) + 1e-9).cast("int")
    named = lambda e: left.select("shingle", *[F.col(c).alias(f"{c}_{e}") for c in ("id", "n", "pos", "component")])
    # the largest set that can reach the threshold with a from its position on
    top = F.floor(F.least(F.col("n_a") * 100 / percent, (F.col("n_a") - F.col("pos_a")) * (100 + percent) / percent - F.col("n_a")) + 1e-6)
    x = named("a").withColumn("top", top).filter(F.col("top") >= F.col("n_a")).withColumn("block", F.explode(F.sequence(block(F.col("n_a")), block(F.col("top")))))
    y = named("b").withColumn("block", block(F.col("n_b")))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    # what can still be common from b's position on, against what has to be
    reach = (F.col("n_b") - F.col("pos_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    more = x.join(y, ["shingle", "block"]).filter((F.col("component_a") != F.col("component_b")) & smaller & (F.col("n_b") <= F.col("top")) & reach)
    more = more.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    seen = pairs.union(pairs.select("b", "a"))
    more = settle(_possible(more.join(seen, ["a", "b"], "left_anti"), full, percent), "more")
    if not more.isEmpty():
        extra = _linked(more, own, percent, words)
        found = group.select("node", "component")
        bridges = extra.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        over = components(bridges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        group = found.join(over.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        alone = over.join(found.select("node"), "node", "left_anti")
        group = settle(group.union(alone), "group")

    answer = nodes.join(group, "node", "left").select("f1", "f2", F.col("n"), F.coalesce("component", "node").alias("component_id"))
    told = full.join(answer, ["f1", "f2", "n"]).select("id", "n", "component_id")
    return told.union(sets.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))).select(F.col("id").alias(doc), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row of each component of rows: that of the smallest doc, null last. Repeated and null ids are rows like others."""
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = settle(jaccard_components(rows, "__row", text, **more).select("__row", F.col("component_id").alias("of")), "components")
    # a group of any size is reduced to its first row before it is shuffled; what follows is by row
    named = found.join(rows.select("__row", F.col(doc).alias("id")), "__row")
    first = named.groupBy("of").agg(F.min(F.struct(F.col("id").isNull(), "id", "__row"))["__row"].alias("first"))
    gone = found.select("__row").join(settle(first, "first").select(F.col("first").alias("__row")), "__row", "left_anti")
    return semi_by_id(rows, settle(gone, "gone"), "__row", "__row", keep=False).drop("__row")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT a, b FROM way UNION SELECT r.doc_id, way.b FROM reach r JOIN way ON r.other = way.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) l ON l.doc_id = w.doc_id
"""
