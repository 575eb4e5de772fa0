import random

import pytest

from larkspur.functions import providers
from larkspur.functions.providers import Batches, Embedded, embedded


class Strict:
    """A token a character; more than `most` of them in a call are refused with their number."""

    retryable_errors = (OSError,)

    def __init__(self, most=80_000, flaky=0):
        self.most, self.flaky, self.calls, self.refused = most, flaky, [], 0

    def embed(self, texts, *, model="", input_type="document"):
        tokens = sum(map(len, texts))
        if self.flaky:
            self.flaky -= 1
            raise OSError("busy")
        if tokens > self.most:
            self.refused += 1
            raise ValueError(f"the batch has {tokens:,} tokens, the limit is {self.most}")
        self.calls.append(list(texts))
        return Embedded([[float(len(t)), float(ord(t[0]))] for t in texts], tokens)


def through(texts, own, batches=None, **more):
    spans = list(embedded(texts, own, "m", batches or Batches(), wait=0, **more))
    assert [a for a, _, _ in spans] == [0, *[b for _, b, _ in spans[:-1]]] and spans[-1][1] == len(texts)
    return [v for a, b, vectors in spans for v in (vectors or [None] * (b - a))]


def test_every_text_gets_through_a_strict_provider():
    rng = random.Random(1)
    texts = [chr(97 + k % 26) * rng.choice([1, 50, 3000, 30_000, 79_999]) for k in range(600)]
    own = Strict()
    assert through(texts, own) == [[float(len(t)), float(ord(t[0]))] for t in texts]
    assert [t for call in own.calls for t in call] == texts and max(map(len, own.calls)) <= 128
    # half a token a character was estimated first; what the refusals named is learnt
    assert 1 <= own.refused <= 6


def test_batches_are_bounded_by_estimates():
    batches = Batches(most_tokens=100, most_items=3)
    texts = ["x" * n for n in (100, 100, 2, 500, 10, 10, 10, 10)]
    ends, at = [], 0
    while at < len(texts):
        at = batches.next(texts, at)
        ends.append(at)
    assert ends == [2, 3, 4, 7, 8]
    batches.learn(["x" * 10], 20)
    assert batches.ratio == 0.5 and batches.estimate("x" * 10) == 20
    batches.learn(["x" * 30], 10)
    assert batches.ratio == pytest.approx(1.0) and batches.estimate("xyz") == 3
    batches.learn(["x" * 1000], 10)
    assert batches.estimate("x" * 100) == 50  # never below half a token a character
    batches.learn(["x"], 0)


def test_errors_that_pass_are_tried_again_and_others_are_told():
    own = Strict(flaky=2)
    assert through(["a", "b"], own, tries=3) == [[1.0, 97.0], [1.0, 98.0]]
    assert through(["a", "b"], Strict(flaky=9), tries=2) == [None, None]
    with pytest.raises(ValueError, match="tokens"):
        through(["x" * 90_000], Strict())


def test_embedding_on_executors(spark):
    df = spark.createDataFrame([(str(k), "y" * (40_000 + k)) for k in range(30)], "content_hash string, text string").coalesce(1)
    rows = providers.embed_missing(df, "hash", "m", width=64, most_tokens=50_000).collect()
    assert {r.content_hash for r in rows} == {str(k) for k in range(30)} and all(len(r.embedding) == 64 for r in rows)
    with pytest.raises(Exception, match="width"):
        providers.embed_missing(df, "hash", "m", width=5).collect()
