"""Language identification with word-first backoff.

A word is a run of letters, in lower case. A known word counts with its log frequency in each language. An unseen word
falls back to its character n-grams, the longest first: the first length of which at least half its n-grams are known
decides, down to single characters. A text's language is that of the greatest sum over its words.

The model is fitted on a bounded sample of labelled texts (SAMPLE, about evenly over languages, chosen by a hash of the
id). Its counts are made on the executors from the whole texts of that sample; every word and n-gram of them is kept.

Edge cases: a null text or one without a letter is `und` with score 0; a text whose characters were all unseen gets
the language with most training words and a low score; ties go to the first language in order; a null id is never
held out nor, as its hash is null, learned from; with no labelled text at all, or an empty table, every prediction is
`und`; repeated rows are predicted each for itself; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table

SAMPLE = 12_000
LONGEST = 4
UNKNOWN = "und"
#: Characters of text that are cut into words at once; a longer text goes alone.
SLICE = 1_000_000
#: Unseen words whose scores a worker remembers.
_REMEMBERED = 50_000


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between marks; single characters go without marks."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def words_of(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """For runs of the texts: place of each word's text, each word's code, and the words by code. Null texts have none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.empty(0, np.int64)
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        lists = pc.split_pattern_regex(pc.utf8_lower(texts.slice(low, high - low)), r"\PL+")
        places, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
        real = pc.not_equal(flat, "")
        coded = flat.filter(real).dictionary_encode()
        yield low + places.filter(real).to_numpy(), coded.indices.to_numpy(), coded.dictionary.to_pylist()
        low = high


class WordFirst:
    """Log frequencies by language. items: (n, item, count in each language), where n is 0 for words."""

    def __init__(self, languages: list[str], lengths: np.ndarray, items: list[str], counts: np.ndarray):
        self.languages = languages
        counts = counts.astype(np.float64).reshape(len(items), len(languages))
        self.rows = np.zeros((len(items), len(languages)), np.float32)
        self.places: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        self.first = 0
        for n in range(LONGEST + 1):
            mine = np.flatnonzero(lengths == n)
            total = counts[mine].sum(axis=0)
            self.rows[mine] = np.log((counts[mine] + 0.5) / (total + 0.5 * len(mine))) if len(mine) else 0
            self.places[n] = {items[k]: int(k) for k in mine}
            if n == 0 and len(languages):
                self.first = int(np.argmax(total))
        self.remembered: dict[str, np.ndarray] = {}

    def of_unseen(self, word: str) -> np.ndarray:
        if (row := self.remembered.get(word)) is not None:
            return row
        row = np.zeros(len(self.languages), np.float32)
        for n in range(LONGEST, 0, -1):
            all_of = grams(word, n)
            known = [k for g in all_of if (k := self.places[n].get(g)) is not None]
            if known and 2 * len(known) >= len(all_of):
                row = self.rows[known].mean(axis=0)
                break
        if len(self.remembered) >= _REMEMBERED:
            self.remembered.clear()
        if len(word) < 100:
            self.remembered[word] = row
        return row

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of every text."""
        found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return found, scores
        known = self.places[0]
        for places, codes, words in words_of(texts):
            if not len(places):
                continue
            of = np.array([known.get(w, -1) for w in words], np.int64)
            rows = self.rows[of].astype(np.float64)
            for k in np.flatnonzero(of < 0):
                rows[k] = self.of_unseen(words[k])
            starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
            count = np.diff(np.append(starts, len(places)))
            # one language at a time, so that a long text needs no matrix
            total = np.stack([np.add.reduceat(rows[codes, k], starts) for k in range(len(self.languages))], axis=1)
            level = np.ptp(total, axis=1) == 0
            best = np.where(level & (len(self.languages) > 1), self.first, np.argmax(total, axis=1))
            # words aren't independent; at most 20 count in full for the score
            spread = (total - total[np.arange(len(total)), best][:, None]) * np.minimum(1.0, 20 / count)[:, None]
            with np.errstate(over="ignore"):
                scores[places[starts]] = 1 / np.exp(spread).sum(axis=1)
            for place, k in zip(places[starts].tolist(), best.tolist(), strict=True):
                found[place] = self.languages[k]
        return found, scores


def train(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> WordFirst:
    """Fits on at most about `sample` rows of docs, which the caller has limited to those that may be learned from."""
    rows = docs.select(F.col(doc).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    languages = sorted(sizes)
    if not languages:
        return WordFirst([], np.empty(0, int), [], np.empty((0, 0)))
    share, chosen = sample / len(languages), F.lit(False)
    for name in languages:
        below = int(min(1.0, share / sizes[name]) * (1 << 30))
        chosen = chosen | ((F.col("lang") == name) & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < below))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
            for places, codes, words in words_of(batch.column(0)):
                times = np.zeros((len(words), len(languages)), np.int64)
                np.add.at(times, (codes, langs[places]), 1)
                made: dict[tuple[int, str], np.ndarray] = {}
                for w, row in zip(words, times, strict=True):
                    for key in [(0, w), *((n, g) for n in range(1, LONGEST + 1) for g in grams(w, n))]:
                        have = made.get(key)
                        made[key] = row if have is None else have + row
                if made:
                    columns = np.stack(list(made.values()), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in made], pa.int32()), pa.array([x for _, x in made], pa.string()), *map(pa.array, columns)], ["n", "item", *ks])

    ks = [f"k{i}" for i in range(len(languages))]
    counted = rows.filter(chosen).select("text", "lang").mapInArrow(count, "n int, item string, " + ", ".join(f"{k} long" for k in ks))
    # all words and n-grams of the sample's texts
    got = counted.groupBy("n", "item").agg(*[F.sum(k).alias(k) for k in ks]).toArrow().sort_by([("n", "ascending"), ("item", "ascending")])
    return WordFirst(languages, got["n"].to_numpy(), got["item"].to_pylist(), np.stack([got[k].to_numpy() for k in ks], axis=1))


def identify(docs: DataFrame, model: WordFirst, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, lang_pred and score of every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(scores)], [doc, "lang_pred", "score"])

    return docs.select(F.col(doc), F.col(text)).mapInArrow(run, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, lang_pred string, score double")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs.filter(fold() != 1))
    return identify(docs, model).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
