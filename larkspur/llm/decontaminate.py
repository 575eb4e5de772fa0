"""Benchmark decontamination: windows of benchmark words found in whole training texts. DataFrame functions alone.

A broadcast hash set holds the 64-bit hashes of all benchmark windows. Every document's word hashes are combined by
doubling (2, 4, 8 words, ...) into window hashes inside its row, without a shuffle; a hash hit is verified against the
window's words. Only verified hits leave the row.

Edge cases: a null or wordless text has no words and is clean; a null or wordless item has no windows; items with equal
windows all count; items of fewer than `size` words are one window; repeated rows are judged each for itself; an empty
benchmark or table of documents is no error, and an empty benchmark leaves every document clean; a null id is an id like
others; further columns of either table are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import ascii_lower, semi_by_id, settle, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: As WORD, in texts that are not lower-cased.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of windows and items in one broadcast hash set; more go in further passes over the documents.
BYTES_PER_PASS = 100_000_000
#: Rows that a window's items are spread over, so that no row grows with the items of a window that many share.
ITEM_ROWS = 256


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds w<n> for every n of lengths: hashes of all windows of n words of column `words`."""
    df = df.withColumn("p1", F.transform("words", lambda w: F.xxhash64(w)))
    have = {1: "p1"}

    def joined(frame: DataFrame, a: int, b: int) -> DataFrame:
        n = a + b
        if n not in have:
            left, right = F.col(have[a]), F.col(have[b])
            count = F.greatest(F.lit(0), F.size("words") - (n - 1))
            frame = frame.withColumn(f"p{n}", F.zip_with(F.slice(left, 1, count), F.slice(right, a + 1, count), lambda x, y: F.xxhash64(x, y)))
            have[n] = f"p{n}"
        return frame

    for n in lengths:
        parts = [1 << k for k in range(n.bit_length()) if n >> k & 1][::-1]
        k = 1
        while k < parts[0]:
            df = joined(df, k, k)
            k *= 2
        so_far = parts[0]
        for part in parts[1:]:
            df = joined(df, so_far, part)
            so_far += part
    return df.select("*", *[F.col(have[n]).alias(f"w{n}") for n in lengths]).drop(*[f"p{n}" for n in have])


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """(n, window array<string>, items array<item>): rows of different windows, more than one where many items have it."""
    items = benchmark.select(F.col(item).alias("item"), words(F.col(text)).alias("words")).filter(F.size("words") > 0)
    n = F.least(F.lit(size), F.size("words"))
    rows = items.select("item", "words", n.alias("n")).select("item", "n", "words", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)).alias("at"))
    windows = rows.select("item", "n", F.slice("words", F.col("at"), F.col("n")).alias("window"))
    return windows.groupBy("n", "window", F.pmod(F.xxhash64("item"), F.lit(ITEM_ROWS)).alias("lot")).agg(F.collect_set("item").alias("items")).drop("lot")


def _hashed(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The windows' hashes, made as the documents' are."""
    parts = []
    for n in lengths:
        one = _window_hashes(windows.filter(F.col("n") == n).withColumnRenamed("window", "words"), [n])
        parts.append(one.select(F.element_at(f"w{n}", 1).alias("hash"), F.col("n").alias("of"), F.col("words").alias("window"), "items"))
    return reduce(DataFrame.union, parts)


def _covered(hits: Column) -> Column:
    """Words inside any of the (at, n) hits, which are sorted."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))

    def add(state: Column, hit: Column) -> Column:
        end = hit["at"] + hit["n"]
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["sum"] + F.greatest(F.lit(0), end - F.greatest(state["end"], hit["at"]))).alias("sum"))

    return F.aggregate(hits, start, add, lambda s: s["sum"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """One row for each row of docs: doc, n_words, n_hit, hits array<struct<at, n>> (word places from 0), items (sorted ids as strings)."""
    windows = settle(benchmark_windows(benchmark, item, item_text, size), "windows")
    # 8 bytes for each word and id beside the characters, 100 for the row
    weight = F.length(F.concat_ws("", "window")) + F.length(F.concat_ws("", F.transform("items", lambda x: x.cast("string")))) + 8 * (F.col("n") + F.size("items")) + 100
    total = windows.groupBy("n").agg(F.sum(weight).alias("bytes")).collect()  # at most `size` rows
    lengths = sorted(r["n"] for r in total)
    passes = -(-sum(r["bytes"] for r in total) // bytes_per_pass) or 1
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), F.col(text).alias("text"))
    if passes > 1:
        own = settle(own, "rows")  # every pass has to see the same row numbers
    base = own.select("row", "doc", words(F.col("text")).alias("words"))
    if not lengths:
        none = F.array().cast("array<struct<at:int,n:int>>")
        return base.select(F.col("doc").alias(doc), F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none.alias("hits"), F.array().cast("array<string>").alias("items"))
    hashed = _hashed(windows, lengths)
    made = _window_hashes(base, lengths)
    found = []
    for k in range(passes):
        # place 0 stands for the row itself and has a hash that only spreads rows; then the windows of each length in turn
        every = F.concat(F.array(F.xxhash64("row")), *[F.col(f"w{n}") for n in lengths])
        rows = made.select("row", "doc", "words", F.posexplode(every).alias("place", "hash"))
        place, at = F.col("place") - 1, F.lit(None).cast("int")
        before = F.lit(0)
        for n in lengths:
            count = F.greatest(F.lit(0), F.size("words") - (n - 1))
            inside = (place >= before) & (place < before + count)
            at = F.when(inside, place - before).otherwise(at)
            before = before + count
        part = hashed if passes == 1 else hashed.filter(F.pmod(F.xxhash64("window", "items"), F.lit(passes)) == k)
        part = part.withColumnsRenamed({"hash": "hash_of"})
        same = (F.col("hash") == F.col("hash_of")) & (F.col("place") > 0) & (F.slice("words", at + 1, F.col("of")) == F.col("window"))
        joined = rows.join(F.broadcast(part), same, "left").filter((F.col("place") == 0) | F.col("of").isNotNull())
        found.append(joined.select("row", "doc", F.when(F.col("place") == 0, F.size("words")).alias("n_words"), F.when(F.col("of").isNotNull(), F.struct(at.alias("at"), F.col("of").alias("n"))).alias("hit"), "items"))
    hits = reduce(DataFrame.union, found).groupBy("row", "doc").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return hits.select(F.col("doc").alias(doc), F.col("n_words").cast("long").alias("n_words"), _covered(F.col("hits")).cast("long").alias("n_hit"), "hits", F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", text: str = "text", **more) -> DataFrame:
    """docs without what the benchmark has.

    action "documents": rows with a hit go. action "spans": the hit words and the separators after them go from the
    texts, and n_chars, where docs has it, follows. The verdict hangs on the text alone, so rows are matched with it by a
    digest of the text, whatever their ids; texts aren't shuffled as long as the hit digests can be broadcast.
    """
    digest = F.sha2(F.col(text), 256)
    judged = docs.select(digest.alias("__digest"), F.col(text).alias("__text"))
    found = find_contamination(judged, benchmark, "__digest", "__text", **more).filter("n_hit > 0")
    if action == "documents":
        bad = settle(found.select("__digest").distinct(), "contaminated")
        return semi_by_id(docs.withColumn("__own", F.coalesce(digest, F.lit(""))), bad, "__own", "__digest", keep=False).drop("__own")
    if action != "spans":
        raise ValueError(f"unknown action {action!r}")
    parts = F.regexp_extract_all(F.col(text), F.lit(f"{WORD_ANY_CASE}|[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    # every word with what follows it, numbered; a separator before the first word has number -1
    state = F.struct(F.lit(-1).alias("k"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, part: Column) -> Column:
        k = s["k"] + F.when(part.rlike(WORD_ANY_CASE), 1).otherwise(0)
        hit = F.exists(F.col("__hits"), lambda h: (k >= h["at"]) & (k < h["at"] + h["n"]))
        return F.struct(k.alias("k"), F.when(hit, s["kept"]).otherwise(F.concat(s["kept"], F.array(part))).alias("kept"))

    cut = F.aggregate(parts, state, step, lambda s: F.concat_ws("", s["kept"]))
    bad = settle(found.groupBy("__digest").agg(F.first("hits").alias("__hits")), "contaminated")  # equal texts have equal hits
    joined = docs.withColumn("__own", digest).join(bad, F.col("__own") == F.col("__digest"), "left")
    joined = joined.withColumn(text, F.when(F.col("__hits").isNotNull(), cut).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__hits").isNotNull(), F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH low AS (SELECT 'd' AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
items AS (SELECT id AS item_id, ws, least(10, len(ws)) AS n FROM w WHERE kind = 'i' AND len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, place, place + n - 1), ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS place FROM items)),
lens AS (SELECT DISTINCT n FROM win),
docwin AS (SELECT id AS doc_id, n, place, array_to_string(list_slice(ws, place, place + n - 1), ' ') AS g FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS place FROM w, lens WHERE kind = 'd' AND len(ws) >= n)),
hit AS (SELECT d.doc_id, d.place, d.n, win.item_id FROM docwin d JOIN win ON win.g = d.g AND win.n = d.n),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(place, place + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cover ON cover.doc_id = w.id LEFT JOIN its ON its.doc_id = w.id WHERE kind = 'd'
"""
