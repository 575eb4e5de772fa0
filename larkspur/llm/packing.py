"""Best-fit packing by a grouping genetic algorithm.

Every text becomes pieces of at most `size` tokens. What a piece weighs is its length alone, so that a packing of any
corpus is a list of patterns (lengths that share a sequence) with counts, over at most `size` lengths. The algorithm
works on that form, whose size doesn't grow with the corpus: a crossover injects whole well-filled sequences of one
parent into the other, takes out the sequences that then hold a length too often, and best-fits what was displaced.
Islands run as Spark tasks; after each round the elite of every island goes to all of them.

Edge cases: a null or empty text has the closing id alone; a text of more than `size` tokens is cut, its first piece
taking the remainder; equal rows are packed each for itself; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import settle, table
from larkspur.llm.tokens import ByteBpe

SIZE = 2048
CLOSING = 0
#: Salts in which the pieces of one length are numbered.
SALTS = 256

Packing = list[tuple[tuple[int, ...], int]]


def best_fit(demand: dict[int, int], size: int, start: Packing = ()) -> Packing:
    """Longest first, each to the fullest sequence with room, by counts: equal sequences are filled together."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for pattern, n in start:
        open_by_room.setdefault(size - sum(pattern), []).append((pattern, n))
    rooms = sorted(open_by_room)
    for length in sorted((k for k, n in demand.items() if n), reverse=True):
        left = demand[length]
        # only rooms from `length` on can take it; what they become is less than they were
        for room in [r for r in rooms if r >= length]:
            if not left:
                break
            most = room // length
            groups, open_by_room[room] = open_by_room[room], []
            for pattern, n in groups:
                full = min(n, left // most)
                made = [(full, most)] if full else []
                left -= full * most
                n -= full
                if n and left:  # fewer than `most` remain: one sequence takes them
                    made.append((1, left))
                    left, n = 0, n - 1
                for count, each in made:
                    open_by_room.setdefault(room - each * length, []).append((pattern + (length,) * each, count))
                if n:
                    open_by_room[room].append((pattern, n))
        if left:
            most = size // length
            if left >= most:
                open_by_room.setdefault(size - most * length, []).append(((length,) * most, left // most))
            if left % most:
                open_by_room.setdefault(size - left % most * length, []).append(((length,) * (left % most), 1))
        rooms = sorted(r for r, g in open_by_room.items() if g)
    merged: Counter = Counter()
    for groups in open_by_room.values():
        for pattern, n in groups:
            merged[pattern] += n
    return sorted(merged.items())


def cost(packing: Packing, size: int) -> tuple[int, float]:
    """Sequences, then how unevenly they are filled: at equal numbers, full and empty beats all alike."""
    return sum(n for _, n in packing), -sum(n * (sum(p) / size) ** 2 for p, n in packing)


def crossover(into: Packing, other: Packing, demand: dict[int, int], size: int, rng: random.Random) -> Packing:
    """Well-filled sequences of other go into `into`; sequences there whose lengths would be held too often go; the displaced are best-fitted."""
    left = dict(demand)
    child: Counter = Counter()
    fullest = sorted(other, key=lambda x: (-sum(x[0]), rng.random()))
    for pattern, n in fullest[: max(1, len(fullest) // 2)]:
        if rng.random() < 0.7:
            take = rng.randint(1, n)
            child[pattern] += take
            for length in pattern:
                left[length] -= take
    for pattern, n in sorted(into, key=lambda x: (-sum(x[0]), rng.random())):
        times = Counter(pattern)
        # the emptiest sequences are always displaced
        keep = min(n, *(left[length] // k for length, k in times.items()))
        if sum(pattern) < size * 0.98:
            keep = keep * rng.randint(0, 3) // 4
        if keep > 0:
            child[pattern] += keep
            for length, k in times.items():
                left[length] -= keep * k
    return best_fit(left, size, sorted(child.items()))


def evolve(population: list[Packing], demand: dict[int, int], size: int, seed: int, generations: int, least: int) -> list[Packing]:
    """One island's generations; its best packings, best first."""
    rng = random.Random(seed)
    pool = sorted(population, key=lambda p: cost(p, size))
    for g in range(generations):
        if g and cost(pool[0], size)[0] <= least:
            break
        a, b = rng.choice(pool[: max(2, len(pool) // 2)]), rng.choice(pool)
        pool = sorted([*pool, crossover(a, b, demand, size, rng)], key=lambda p: cost(p, size))[:6]
    return pool


def pack_lengths(spark: SparkSession, demand: dict[int, int], size: int = SIZE, islands: int = 4, rounds: int = 2, generations: int = 6, seed: int = 7) -> Packing:
    """demand: how many pieces have each length. Stops after the first round in which no packing could have fewer sequences."""
    first = best_fit(demand, size)
    total = sum(k * n for k, n in demand.items())
    # a piece over half the size shares no sequence with another such piece
    least = max(-(-total // size), sum(n for k, n in demand.items() if 2 * k > size))
    elite = [first]
    for r in range(rounds):
        if not demand or (r and cost(elite[0], size)[0] <= least):
            break
        pool = list(elite)

        def island(k: int, pool: list[Packing] = pool, r: int = r) -> list[Packing]:
            rng = random.Random(f"{seed}:{r}:{k}")
            own = list(pool)
            while len(own) < 3:  # other starts: part of a packing is taken apart at random
                own.append(crossover(pool[0], [], demand, size, rng) if rng.random() < 0.5 else crossover([x for x in pool[0] if rng.random() < 0.6], pool[0], demand, size, rng))
            return evolve(own, demand, size, rng.randrange(1 << 30), generations, least)[:2]

        def run(batches: Iterator[pa.RecordBatch], island=island) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    best = island(k)
                    yield pa.RecordBatch.from_pydict({"island": [k] * len(best), "patterns": [[list(p) for p, _ in x] for x in best], "counts": [[n for _, n in x] for x in best]}, pa.schema([("island", pa.int64()), ("patterns", pa.list_(pa.list_(pa.int32()))), ("counts", pa.list_(pa.int64()))]))

        # one island's elite: two lists of patterns over at most `size` lengths
        rows = spark.range(0, islands, 1, islands).mapInArrow(run, "island long, patterns array<array<int>>, counts array<long>").collect()
        found = [[(tuple(p), n) for p, n in zip(x["patterns"], x["counts"], strict=True)] for x in sorted(rows, key=lambda x: x["island"])]
        elite = sorted([*elite, *found], key=lambda p: cost(p, size))[: islands + 1]
    return elite[0]


def pieces(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", size: int = SIZE, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """doc, piece, start, length, ids_crc32 and, if asked for, ids of every piece of every text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                which, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, t in enumerate(part.column(1)):
                    row = np.append(bpe.array(t.as_py() or ""), np.uint32(closing)).astype("<u4")
                    first = len(row) % size or size
                    edges = [0, *range(first, len(row) + 1, size)] if len(row) > size else [0, len(row)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        which.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(row[a:b].tobytes()))
                        if with_ids:
                            ids.append(row[a:b].astype(np.int64))
                columns = [part.column(0).take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [doc, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[doc].dataType.simpleString()
    schema = f"`{doc}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col(doc), F.col(text)).mapInArrow(cut, schema)


def pack(cut: DataFrame, doc: str = "doc_id", size: int = SIZE, **more) -> DataFrame:
    """Adds sequence_id and offset to the pieces in cut, whose column length is at most size; cut is settled by the caller."""
    spark = cut.sparkSession
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(doc, "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = settle(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")  # at most size * SALTS rows, too many for the driver
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()}  # at most size rows
    # how many pieces of the length have smaller salts
    smaller = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("before"))
    packing = pack_lengths(spark, demand, size, **more)
    # places for the pieces of each length, in turn: from the how-manieth piece on, the first sequence, the offset
    steps: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for pattern, n in packing:
        at = 0
        for length in pattern:
            steps.setdefault(length, []).append((used[length], base, at))
            used[length] += n
            at += length
        base += n
    plan = {k: np.array(v, dtype=np.int64) for k, v in steps.items()}
    shared = spark.sparkContext.broadcast(plan)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                here = np.flatnonzero(length == one)
                table = plan[int(one)]
                k = np.searchsorted(table[:, 0], rank[here], side="right") - 1
                sequence[here] = table[k, 1] + rank[here] - table[k, 0]
                offset[here] = table[k, 2]
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy(doc, "piece", "ids_crc32")
    numbered = salted.withColumn("n", F.row_number().over(order)).join(before, ["length", "salt"]).select(*cut.columns, (F.col("n") - 1 + F.col("before")).alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    return numbered.mapInArrow(deal, schema)


def pack_documents(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", size: int = SIZE, **more) -> DataFrame:
    """Every piece of every text with its sequence and its place there."""
    return pack(settle(pieces(docs, tokenizer, doc, text, size), "pieces"), doc, size, **more)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
