"""Streaming variants: chunks kept up to date from arriving files, and fact chains folded as facts arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larkspur.functions import chunk, text
from larkspur.operators import index
from larkspur.sources.store import Store

CHUNKS = "id string, file_path string, chunk_index int, start_line int, end_line int, chunk string, content_hash string"


def chunks_of(files: DataFrame) -> DataFrame:
    """files: file_path, content."""
    made = chunk.line_windows(files, text="content")
    return made.selectExpr("concat('code:', file_path, ':', chunk_index) AS id", "file_path", "chunk_index", "start_line", "end_line", "chunk").withColumn("content_hash", text.content_hash(made["chunk"]))


def keep_chunks(files: DataFrame, store: Store, name: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch replaces the chunks of its files, in the buckets of these files alone; a batch that is run again leaves
    the same rows. Of several versions of a file in one batch the one with the largest content counts, whichever came first."""

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        last = index.last_of_each(batch, ["file_path"], "content")
        store.replace(name, CHUNKS, chunks_of(last), last, ["file_path"])

    return files.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FOLDED = "chain_key string, object string, valid_from long, nth int, action string, version int"
_HISTORY = "object string, valid_from bigint, nth int, action string, version int"
_BASE = "object string, valid_from bigint, version int"


class _Chain(StatefulProcessor):
    """The history of one chain, oldest first, in a list; what is older than the newest by more than `keep` is summed up in a base."""

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history, self.base = handle.getListState("history", _HISTORY), handle.getValueState("base", _BASE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        base = self.base.get() if self.base.exists() else (None, None, 0)
        told = {(r[1], r[0], r[2]): (r[3], r[4]) for r in self.history.get()} if self.history.exists() else {}
        out, times = [], {}
        for valid_from, value, _ in told:
            times[valid_from, value] = times.get((valid_from, value), 0) + 1
        facts = list(told)
        for frame in rows:
            for value, at in zip(frame["object"], frame["valid_from"], strict=True):
                if base[1] is not None and at <= base[1]:
                    out.append((key[0], value, int(at), -1, "LATE", base[2]))
                    continue
                times[int(at), value] = n = times.get((int(at), value), 0) + 1
                facts.append((int(at), value, n - 1))
        held, version, now = base[0], base[2], {}
        for fact in sorted(facts):
            action = "NOOP" if version and fact[1] == held else "SUPERSEDE" if version else "INSERT"
            if action != "NOOP":
                held, version = fact[1], version + 1
            now[fact] = (action, version)
            if told.get(fact) != now[fact]:
                out.append((key[0], fact[1], fact[0], fact[2], action, version))
        limit = max(f[0] for f in now) - self.keep if now and self.keep is not None else None
        for fact in sorted(now):
            if limit is not None and fact[0] < limit:
                base = (fact[1] if now[fact][0] != "NOOP" else base[0], fact[0], now.pop(fact)[1])
        if base[1] is not None:
            self.base.update(base)
        self.history.put([(f[1], f[0], f[2], *now[f]) for f in sorted(now)])
        yield pd.DataFrame(out, columns=["chain_key", "object", "valid_from", "nth", "action", "version"])

    def close(self) -> None:
        pass


def fold_facts(facts: DataFrame, keep: int | None = None) -> DataFrame:
    """Actions of facts (chain_key, object, valid_from) as they arrive, in the end those of a batch over all of them.

    A late fact takes its place in the chain's history and corrects what follows: a row with the key of an earlier one
    (chain_key, valid_from, object, nth of equal facts) replaces it. With `keep`, in the unit of valid_from, a chain remembers
    only that much before its newest fact; a fact older than that is LATE, with nth -1, and changes nothing.
    """
    facts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return facts.select("chain_key", "object", "valid_from").groupBy("chain_key").transformWithStateInPandas(_Chain(keep), FOLDED, "Update", "None")


def keep_facts(facts: DataFrame, store: Store, name: str, checkpoint: str, keep: int | None = None) -> StreamingQuery:
    """fold_facts into a table of FOLDED's columns, corrections in place. Facts that are LATE aren't kept."""

    def apply(batch: DataFrame, _: int) -> None:
        store.upsert(name, FOLDED, batch.filter("nth >= 0"), ["chain_key", "valid_from", "object", "nth"], by=["chain_key"])

    return fold_facts(facts, keep).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
