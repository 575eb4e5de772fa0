"""Embedding providers."""

from __future__ import annotations

import hashlib
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from larkspur.operators.index import BATCH_ITEMS, BATCH_TOKENS
from larkspur.operators.upkeep import TOKENS_IN_ERROR


class Embedded(NamedTuple):
    embeddings: list[list[float]]
    total_tokens: int


class EmbedProvider(Protocol):
    retryable_errors: tuple[type[Exception], ...]

    def embed(self, texts: list[str], *, model: str, input_type: str) -> Embedded: ...


class HashProvider:
    """Offline default: signed hashes of words and their neighbours, of unit length. Equal texts have equal vectors."""

    retryable_errors: tuple[type[Exception], ...] = ()

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str], *, model: str = "", input_type: str = "document") -> Embedded:
        out, total = [], 0
        for text in texts:
            words = text.lower().split()
            total += len(words)
            v = np.zeros(self.width)
            for feature in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = int.from_bytes(hashlib.blake2b(f"{model}:{feature}".encode(), digest_size=8).digest(), "little")
                v[h % self.width] += 1 if h >> 32 & 1 else -1
            out.append((v / (np.linalg.norm(v) or 1)).tolist())
        return Embedded(out, total)


PROVIDERS = {"hash": HashProvider}
_made: dict[str, EmbedProvider] = {}


def provider(name: str) -> EmbedProvider:
    """Made once in each process. Others are added to PROVIDERS."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known are {', '.join(sorted(PROVIDERS))}")
    return _made.setdefault(name, PROVIDERS[name]())


def with_retries(call, errors: tuple[type[Exception], ...], tries: int = 5, wait: float = 20.0):
    """call(), again after 1, 2, ... times `wait` seconds where it fails with one of errors."""
    for k in range(tries):
        try:
            return call()
        except errors:
            if k == tries - 1:
                raise
            time.sleep(wait * (k + 1))


#: The number of tokens that a message of a batch too large names.
_TOKENS = re.compile(TOKENS_IN_ERROR)


def tokens_told(error: Exception) -> int | None:
    """What a provider's error says of the batch's tokens, from which the estimate of characters a token can be mended."""
    found = _TOKENS.search(str(error))
    return int(found[1].replace(",", "")) if found else None


class TooManyTokens(Exception):
    """The provider has refused a batch and named its tokens."""


class Batches:
    """Cuts texts, in order, into batches of at most so many estimated tokens and items. The estimate is mended by what each
    batch turns out to have, as a moving average of characters a token; it never falls below half a token a character."""

    def __init__(self, most_tokens: int = BATCH_TOKENS, most_items: int = BATCH_ITEMS):
        self.most_tokens, self.most_items, self.ratio = most_tokens, most_items, None

    def estimate(self, text: str) -> int:
        return max(len(text) // 2, int(len(text) / self.ratio) if self.ratio else 0)

    def learn(self, texts: list[str], tokens: int) -> None:
        chars = sum(map(len, texts))
        if tokens > 0 and chars:
            self.ratio = chars / tokens if self.ratio is None else 0.8 * self.ratio + 0.2 * chars / tokens

    def next(self, texts: list[str], at: int) -> int:
        """Where the batch that begins at `at` ends; one text is a batch, whatever its tokens."""
        end, used = at, 0
        while end < len(texts) and end - at < self.most_items:
            used += self.estimate(texts[end])
            if end > at and used > self.most_tokens:
                break
            end += 1
        return end


def embedded(texts: list[str], own: EmbedProvider, model: str, batches: Batches, tries: int = 5, wait: float = 20.0) -> Iterator[tuple[int, int, list | None]]:
    """(first, end, vectors) of the batches of texts, in order; vectors is None where all tries have failed.

    A batch that the provider refuses with its number of tokens is halved, again if need be, and the estimate learns from it.
    A single text that is refused is an error.
    """

    def call(a: int, b: int) -> Embedded:
        try:
            return own.embed(texts[a:b], model=model, input_type="document")
        except Exception as e:
            if b - a > 1 and (tokens := tokens_told(e)):
                batches.learn(texts[a:b], tokens)
                raise TooManyTokens from e
            raise

    at, halves = 0, []
    while at < len(texts):
        end = halves.pop() if halves else batches.next(texts, at)
        try:
            got = with_retries(lambda a=at, b=end: call(a, b), own.retryable_errors, tries, wait)
        except TooManyTokens:
            halves += [end, at + (end - at) // 2]
            continue
        except own.retryable_errors:
            yield at, end, None
        else:
            batches.learn(texts[at:end], got.total_tokens)
            yield at, end, got.embeddings
        at = end


def embed_missing(texts: DataFrame, name: str, model: str, width: int | None = None, most_items: int = BATCH_ITEMS, most_tokens: int = BATCH_TOKENS, tries: int = 5, wait: float = 20.0) -> DataFrame:
    """(model, content_hash, embedding) of texts (content_hash, text), which the caller has made distinct.

    Batches are bounded by estimated tokens and by items, see `embedded`. A batch that fails in all tries with an error that
    may pass is skipped: its embeddings are null, so that its files don't count as complete and come again in the next run.
    Any other error fails the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, batches = provider(name), Batches(most_tokens, most_items)
        for frame in frames:
            for a, b, vectors in embedded(list(frame["text"]), own, model, batches, tries, wait):
                vectors = [None] * (b - a) if vectors is None else vectors
                if width is not None and any(v is not None and len(v) != width for v in vectors):
                    raise ValueError(f"{name} gave vectors of another width than {width}")
                yield pd.DataFrame({"model": model, "content_hash": frame["content_hash"].iloc[a:b], "embedding": [None if v is None else np.asarray(v, np.float32) for v in vectors]})

    return texts.select("content_hash", "text").mapInPandas(run, "model string, content_hash string, embedding array<float>")


class QueryCache:
    """Embeddings of the last queries, for at most that many of them and seconds; least used ones go first."""

    def __init__(self, most: int = 256, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.held: OrderedDict[tuple[str, str], tuple[float, list[float]]] = OrderedDict()

    def embed(self, own: EmbedProvider, texts: list[str], model: str) -> list[list[float]]:
        now = self.clock()
        for key in [k for k, (at, _) in self.held.items() if now - at >= self.seconds]:
            del self.held[key]
        known = {t: self.held[t, model][1] for t in texts if (t, model) in self.held}
        if missing := [t for t in dict.fromkeys(texts) if t not in known]:
            got = own.embed(missing, model=model, input_type="query").embeddings
            known |= dict(zip(missing, got, strict=True))
        for t in texts:
            self.held.setdefault((t, model), (now, known[t]))
            self.held.move_to_end((t, model))
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return [known[t] for t in texts]


class LoadedProvider:
    """A local model: `load` makes it on first use. Vectors get unit length; queries have a prompt before them; the first
    batch shows whether the model's width is the one that is registered for it."""

    retryable_errors: tuple[type[Exception], ...] = ()

    def __init__(self, load: Callable[[str], Callable[[list[str]], list[list[float]]]], widths: dict[str, int], prompt: str = ""):
        self.load, self.widths, self.prompt = load, widths, prompt
        self.models: dict[str, Callable] = {}

    def embed(self, texts: list[str], *, model: str, input_type: str = "document") -> Embedded:
        if model not in self.widths:
            raise ValueError(f"unknown model {model!r}")
        first = model not in self.models
        run = self.models.setdefault(model, self.load(model)) if first else self.models[model]
        vectors = np.asarray(run([self.prompt + t if input_type == "query" else t for t in texts]), float).reshape(len(texts), -1)
        if first and len(texts) and vectors.shape[1] != self.widths[model]:
            del self.models[model]
            raise ValueError(f"{model} gives {vectors.shape[1]} numbers, {self.widths[model]} are registered")
        norms = np.linalg.norm(vectors, axis=1, keepdims=True)
        return Embedded((vectors / np.where(norms == 0, 1, norms)).tolist(), sum(len(t.split()) for t in texts))
