"""Quality classifier by co-training.

Two views of a document: its text (which telling words, beginnings of words and marks it has) and its page metadata
(source, language and layout: length, lines, shares of character classes, repetition). Each view has a logistic classifier.
Over rounds a view labels those documents of an unlabelled pool of which it is surest, for the other view to learn from,
provided that it was right about such documents on a calibration fold. The views are then calibrated and combined on that
fold, and all documents are scored. There are two heads: low quality and toxic; a document that either rejects goes.

The classifiers are fitted on a bounded sample of labelled rows (SAMPLE) and pool of unlabelled ones (POOL), whole
texts, chosen by a hash of the id. What tells is counted on the executors over the sample, and everything that tells
enough (LEAST_G) is used. Every document is scored.

Edge cases: a null text counts as empty, a null source or language as a value of its own; labels with a null id or
null value are not learned from, several labels of one id count as the worst; of several rows with one id the least by
text, source and language is learned from; with labels of one class alone, or none, a head says that class's opposite
never; repeated rows are scored each for itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import settle, table

SAMPLE = 6_000
POOL = 3_000
ROUNDS = 3
#: Lengths of the beginnings of words that are features beside the words.
BEGINNINGS = range(4, 8)
#: G-squared from which a feature tells, and in how many documents it has to be: about one in 20,000 without a bearing comes so far.
LEAST_G, LEAST_SEEN = 20.0, 3
SOURCES, LANGUAGES = 32, 16
#: Rows of a matrix that are made double precision at once.
LINES = 500

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = True
_SYMBOL[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
LAYOUT = 12 + SOURCES + LANGUAGES


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def layout_of(text: str, tokens: list[str], source: str | None, lang: str | None) -> np.ndarray:
    out = np.zeros(LAYOUT, np.float32)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    n, words, lines = max(1, int(raw.sum())), max(1, len(tokens)), int(raw[10]) + 1
    repeats = sum(map(operator.eq, tokens, tokens[1:]))
    out[:12] = (np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 10, raw[_UPPER].sum() / n, raw[_DIGIT].sum() / n, raw[_SYMBOL].sum() / n, raw[124] / n, raw[33] / n, len(set(tokens)) / words, repeats / words, np.log1p(n / words) / 3, float(repeats > 3))
    out[12 + zlib.crc32((source if source is not None else "\0").encode()) % SOURCES] = 1
    out[12 + SOURCES + zlib.crc32((lang if lang is not None else "\0").encode()) % LANGUAGES] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 150, below: np.ndarray | None = None) -> np.ndarray:
    """Weights of a regularised logistic regression, the last one without a column; by accelerated gradient steps.

    below: more rows, under those of x. The matrix is held once more, in single precision; sums over its rows are made in
    double precision, from LINES rows at a time.
    """
    below = x[:0] if below is None else below
    a = np.ones((len(x) + len(below), x.shape[1] + 1), np.float32)
    a[: len(x), :-1], a[len(x) :, :-1] = x, below
    w = np.zeros(a.shape[1], np.float32)
    look, t = w.copy(), 1.0
    vector = np.ones(a.shape[1], np.float32)
    for _ in range(15):  # the steepest curvature bounds the step
        vector = a.T @ (a @ vector)
        vector /= np.linalg.norm(vector) or 1
    rate = 1.0 / (0.25 * np.linalg.norm(a @ vector) ** 2 + l2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ look, -30, 30)))
        gradient = l2 * np.append(look[:-1], 0) + sum(a[k : k + LINES].T @ (p - y)[k : k + LINES] for k in range(0, len(a), LINES))
        new = look - rate * gradient.astype(np.float32)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


class Vocabulary:
    """Features of the text view: words and marks, and beginnings of longer words, which end in a blank."""

    def __init__(self, features: list[str]):
        self.place = {f: i for i, f in enumerate(features)}
        self.words = frozenset(f for f in features if f[-1] != " ")
        self.begin = frozenset(f[: BEGINNINGS[0]] for f in features if f[-1] == " ")

    def of(self, tokens: list[str]) -> dict[int, float]:
        """Features of a text by their place, each with the binary logarithm of 1 + its times."""
        times: dict[int, int] = {}
        for t in tokens:
            if t in self.words:
                k = self.place[t]
                times[k] = times.get(k, 0) + 1
            if t[: BEGINNINGS[0]] in self.begin:
                for b in beginnings(t):
                    if (k := self.place.get(b)) is not None:
                        times[k] = times.get(k, 0) + 1
        return {k: math.log2(1 + n) for k, n in times.items()}


def beginnings(token: str) -> list[str]:
    return [token[:k] + " " for k in BEGINNINGS if k < len(token)]


def telling(of: Column, with_of: Column, n: int, pos: int) -> Column:
    """G-squared of a feature that `of` documents have, `with_of` of them in the class that has pos of n documents."""
    total = F.lit(0.0)
    for seen, among, share in ((with_of, of, pos / n), (of - with_of, of, 1 - pos / n), (F.lit(pos) - with_of, F.lit(n) - of, pos / n), (F.lit(n - pos) - (of - with_of), F.lit(n) - of, 1 - pos / n)):
        total = total + F.when(seen > 0, 2 * seen * F.log(seen / (among * share))).otherwise(0.0)
    return total


def co_train(text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, learnt: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of both views and of their combination. The labelled documents after the first `learnt` are kept for calibration."""
    fold = slice(learnt, None)
    views = {"text": (text_x, pool_text), "meta": (meta_x, pool_meta)}
    extra: dict[str, dict[int, float]] = {"text": {}, "meta": {}}
    weights: dict[str, np.ndarray] = {}

    def fit() -> None:
        for v, (x, pool) in views.items():
            k = np.array(sorted(extra[v]), int)
            weights[v] = logistic(x[:learnt], np.concatenate([y[:learnt], [extra[v][int(i)] for i in k]]), below=pool[k])

    fit()
    for _ in range(rounds if len(pool_text) else 0):
        for v, other in (("text", "meta"), ("meta", "text")):
            x, pool = views[v]
            score, sure_of = logit(pool, weights[v]), logit(x[fold], weights[v])
            for label, sign in ((1.0, 1), (0.0, -1)):
                sure = sign * sure_of > 3
                if sure.sum() < 5 or (y[fold][sure] == label).mean() < 0.98:
                    continue
                best = np.argsort(-sign * score, kind="stable")[: max(1, len(pool) // 20)]
                for i in best:
                    if sign * score[i] > 3 and int(i) not in extra[v]:
                        extra[other][int(i)] = label
        fit()
    z = np.stack([logit(text_x[fold], weights["text"]), logit(meta_x[fold], weights["meta"])], axis=1) / 4
    enough = min(y[fold].sum(), (1 - y[fold]).sum()) >= 5
    combined = logistic(z.astype(np.float32), y[fold], l2=0.1, steps=400) if enough else np.array([2.0, 2.0, 0.0])
    return weights["text"], weights["meta"], combined


class Head:
    """One question put to all documents: weights of the vocabulary and of the layout, and of both views together."""

    def __init__(self, text_w: np.ndarray, meta_w: np.ndarray, combined: np.ndarray):
        self.text_w, self.meta_w, self.combined = text_w, meta_w, combined

    def score(self, features: dict[int, float], layout: np.ndarray) -> float:
        text = float(self.text_w[-1]) + sum(float(self.text_w[k]) * v for k, v in features.items())
        meta = float(layout @ self.meta_w[:-1] + self.meta_w[-1])
        z = self.combined[0] * np.clip(text, -30, 30) / 4 + self.combined[1] * np.clip(meta, -30, 30) / 4 + self.combined[2]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Model:
    """Both heads and the vocabulary that they share."""

    def __init__(self, vocabulary: list[str], heads: dict[str, Head]):
        self.vocabulary, self.heads = Vocabulary(vocabulary), heads

    def score(self, text: str, source: str | None, lang: str | None) -> tuple[float, float]:
        """Probabilities of low quality and toxicity."""
        tokens = tokens_of(text)
        features, layout = self.vocabulary.of(tokens), layout_of(text, tokens, source, lang)
        return self.heads["bad"].score(features, layout), self.heads["toxic"].score(features, layout)


def _counts(sample: DataFrame) -> DataFrame:
    """feature, n, bad, toxic: documents with the feature, and how many of those are of low quality and toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: dict[str, list[float]] = {}
            for text, *labels in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                tokens = set(tokens_of(text or ""))
                for f in tokens.union(*map(beginnings, tokens)):
                    row = made.setdefault(f, [0.0, 0.0, 0.0])
                    row[0] += 1
                    row[1] += labels[0]
                    row[2] += labels[1]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string()), *(pa.array(c, pa.float64()) for c in zip(*made.values(), strict=True))], ["feature", "n", "bad", "toxic"])

    made = sample.select("text", "bad", "toxic").mapInArrow(run, "feature string, n double, bad double, toxic double")
    return made.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("toxic").alias("toxic")).filter(F.col("n") >= LEAST_SEEN)


def _features(sample: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, values, layouts = [], [], []
            for t, s, g in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                tokens = tokens_of(t or "")
                features = vocabulary.of(tokens)
                found.append(list(features))
                values.append(list(features.values()))
                layouts.append(layout_of(t or "", tokens, s, g))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(5), batch.column(6), pa.array(found, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(layouts, pa.list_(pa.float32()))], ["id", "bad", "toxic", "fold", "features", "values", "layout"])

    return sample.select("doc_id", "text", "source", "lang", "bad", "toxic", "fold").mapInArrow(run, f"id {sample.schema['doc_id'].dataType.simpleString()}, bad double, toxic double, fold boolean, features array<int>, values array<float>, layout array<float>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pool: int = POOL) -> Model:
    """Heads "bad" and "toxic". docs: doc_id, text, source, lang; labels: doc_id, quality, toxic."""
    worst = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((1 - F.min("quality")).cast("double").alias("bad"), F.max("toxic").cast("double").alias("toxic"))
    hashed = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    below = lambda n, of: int(min(1.0, n / max(1, of)) * (1 << 30))
    chosen = worst.filter(hashed() < below(sample, worst.count())).orderBy(hashed(), "doc_id").limit(sample)
    own = docs.select("doc_id", "text", "source", "lang")
    labelled = own.join(F.broadcast(chosen), "doc_id")  # at most `sample` small rows
    other = F.pmod(F.xxhash64("doc_id", F.lit("pool")), F.lit(1 << 30)) < below(pool, docs.count())
    unlabelled = own.filter(other).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti").withColumns({"bad": F.lit(None).cast("double"), "toxic": F.lit(None).cast("double")})
    one = F.min(F.struct("text", "source", "lang", "bad", "toxic")).alias("one")
    rows = labelled.union(unlabelled.select(labelled.columns)).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(one).select("doc_id", "one.*")
    rows = settle(rows.withColumn("fold", F.crc32(F.concat(F.lit("fold"), F.col("doc_id").cast("string")).cast("binary")) % 4 == 0), "sample")
    learnt = rows.filter("bad IS NOT NULL AND NOT fold")
    n, bad, toxic = learnt.agg(F.count("*"), F.sum("bad"), F.sum("toxic")).first()
    g = {c: telling(F.col("n"), F.col(c), n, pos) if pos and pos < n else F.lit(0.0) for c, pos in (("bad", bad), ("toxic", toxic))}
    tells = _counts(learnt).select("feature", *[v.alias(c) for c, v in g.items()]).filter((F.col("bad") >= LEAST_G) | (F.col("toxic") >= LEAST_G)).toArrow().sort_by("feature")
    names = tells["feature"].to_pylist()
    got = _features(rows, Vocabulary(names)).toArrow()  # about sample + pool small rows
    got = got.take(np.lexsort((np.array([zlib.crc32(str(i).encode()) for i in got["id"].to_pylist()]), got["fold"].to_numpy()))).combine_chunks()
    layout = got["layout"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, LAYOUT)
    fold = got["fold"].to_numpy()
    # the features stay a list of cells; a matrix is made of those rows and columns alone that a head learns from
    features = got["features"].combine_chunks()
    row, column, value = np.repeat(np.arange(got.num_rows, dtype=np.int32), features.value_lengths().to_numpy()), features.flatten().to_numpy(), got["values"].combine_chunks().flatten().to_numpy()

    def matrix(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        place = np.full(len(names), -1)
        place[columns] = np.arange(len(columns))
        here = rows[row] & (place[column] >= 0)
        x = np.zeros((rows.sum(), len(columns)), np.float32)
        x[(np.cumsum(rows) - 1)[row[here]], place[column[here]]] = value[here]
        return x

    heads = {}
    for name in ("bad", "toxic"):
        y = got[name].to_numpy()
        has = ~np.isnan(y)
        if len(set(y[has])) < 2 or len(set(y[has & ~fold])) < 2:
            value = -30.0 if not has.any() or y[has].mean() < 0.5 else 30.0
            heads[name] = Head(np.zeros(len(names) + 1), np.zeros(LAYOUT + 1), np.array([0.0, 0.0, value]))
            continue
        mine = np.flatnonzero(tells[name].to_numpy() >= LEAST_G)
        # of features in the same documents one is enough
        mine = mine[np.unique(np.bincount(column, np.random.default_rng(7).random(len(y))[row] * value, len(names))[mine], return_index=True)[1]]
        text_w, meta_w, combined = co_train(matrix(has, mine), layout[has], y[has], matrix(~has, mine), layout[~has], int((has & ~fold).sum()))
        whole = np.zeros(len(names) + 1)
        whole[[*mine, -1]] = text_w
        heads[name] = Head(whole, meta_w, combined)
    return Model(names, heads)


def scores(spark: SparkSession, model: Model, text: Column, source: Column, lang: Column) -> Column:
    """struct<p_bad, p_toxic> of a row."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("p_bad double, p_toxic double")
    def run(texts: pd.Series, sources: pd.Series, langs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.score(t or "", s, g) for t, s, g in zip(texts, sources, langs, strict=True)], columns=["p_bad", "p_toxic"], dtype=float)

    return run(text, source, lang)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with p_bad, p_toxic, quality_score and keep."""
    scored = docs.withColumn("__s", scores(docs.sparkSession, model, F.col("text"), F.col("source"), F.col("lang")))
    bad, toxic = F.col("__s.p_bad"), F.col("__s.p_toxic")
    return scored.select(*[F.col(c) for c in docs.columns], bad.alias("p_bad"), toxic.alias("p_toxic"), ((1 - bad) * (1 - toxic)).alias("quality_score"), ((bad < threshold) & (toxic < threshold)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    return score_documents(docs, train(docs, labels)).filter("keep").select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_documents(docs.select("doc_id", "text", "source", "lang"), train(docs, labels)).select("doc_id", "p_bad", "p_toxic", "quality_score", "keep")
