"""Prefix trie of conversations, by Patricia construction.

A conversation is a path: the digests of its turns, one after the other, so that order and shared beginnings of paths are
those of the turns, and texts are not moved. Different paths are sorted by ranges. Each range makes only the points where
paths branch, end or have no more turns, with compressed edges between them, from the common beginnings of neighbours;
the aggregates are summed from point to point. Unary nodes come last, out of the edges, by suffix sums along an edge.

A trie that many tasks share is put together as follows. A range knows how much its first path has in common with the last
one of the range before (`left`) and its last with the first one of the range after (`right`). The nodes on these two
beginnings are in several ranges; there every count is a share that only has to be added up, as a node's own turn is
saved once, by the range where it begins. These few nodes are grouped by a digest of their path; all others are whole in
one range. So neither a first turn that a third of all conversations have nor a group of copies is one task's work: copies
are brought together by the hundred ids, and only their digest of ids is read in order, as a stream.

Bounds: a conversation is a row of 40 bytes a turn, and a range has about RANGE different paths in memory.

Edge cases: turns of one conversation with an equal (or null) number are ordered by the digest of role and text; repeated
rows are turns of their own; a null role or text is an empty one; rows without a conv_id belong to no conversation and are
left out; a conversation of which nothing is left ends at the root; an empty table has no nodes; other columns aren't
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import settle, table

#: Bytes of a turn's digest in a path.
STEP = 16
#: Different paths in a range, about.
RANGE = 50_000
#: Copies of a node's row that its children are spread over.
SALTS = 16
EMPTY = hashlib.sha256().hexdigest()


def turn_lists(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns array<struct<turn, digest, chars>> in order; digest is the hexadecimal beginning of SHA-256 over role and text."""
    who, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, 2 * STEP)
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.length(said).alias("chars"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns"))


def shared_heads(lists: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c % group, and goes on with its own turns after its first h; h is crc32(c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % group
    heads = lists.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, most).alias("head"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    lent = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    return lists.withColumn("first", first).join(heads, "first", "left").select("conv_id", F.concat(lent, own).alias("turns"))


def _shared(a: bytes | None, b: bytes | None) -> int:
    """Turns that two paths have in common at their beginning."""
    if a is None or b is None:
        return 0
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * STEP : mid * STEP] == b[low * STEP : mid * STEP]:
            low = mid
        else:
            high = mid - 1
    return low


def sorted_paths(lists: DataFrame) -> DataFrame:
    """part, path, chars, n, low, ends: different paths with their number of conversations, smallest id and digest of ids. Rows of a part are a range of paths."""
    paths = lists.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    # at most 1000 ids on either side of zero share a lot
    lots = paths.groupBy("path", "chars", F.expr("conv_id div 1000").alias("lot")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    parts = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lists.count() // RANGE))
    ordered = lots.repartitionByRange(parts, "path").sortWithinPartitions("path", "lot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = ((r["path"], r["chars"], r["ids"]) for b in batches for r in b.to_pylist())
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["part", "path", "chars", "n", "low", "ends"])

        kinds = [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
        for path, lots_of_it in groupby(rows, key=lambda r: r[0]):
            digest, n, low = hashlib.sha256(), 0, None
            for _, chars, ids in lots_of_it:
                digest.update((("," if n else "") + ",".join(map(str, ids))).encode())
                n, low = n + len(ids), ids[0] if low is None else low
            out.append((part, path, chars, n, low, digest.hexdigest()))
            if len(out) == 2000:
                yield made()
                out.clear()
        if out:
            yield made()

    return ordered.mapInArrow(run, "part int, path binary, chars array<int>, n long, low long, ends string")


class _Point:
    """Root, branch, end or leaf: a node of the compressed tree. first: the place of the first path through it; key: its digest if other ranges may have it too."""

    __slots__ = ("depth", "first", "n", "low", "leaves", "children", "saved", "ends", "barren", "key")

    def __init__(self, depth: int, first: int, n: int = 0, low: int | None = None, ends: str | None = None):
        self.depth, self.first, self.n, self.low, self.ends = depth, first, n, low, ends
        self.leaves, self.children, self.saved, self.barren, self.key = 0, 0, 0, True, None

    def add(self, n: int, low: int | None, leaves: int, children: int, saved: int) -> None:
        self.n += n
        self.low = low if self.low is None else self.low if low is None else min(self.low, low)
        self.leaves, self.children, self.saved, self.barren = self.leaves + leaves, self.children + children, self.saved + saved, False


def _keys(path: bytes, depth: int) -> list[bytes]:
    """Digests of the path's beginnings of 0 to depth turns."""
    so_far, out = hashlib.blake2b(digest_size=STEP), []
    for d in range(depth + 1):
        out.append(so_far.digest())
        so_far.update(path[d * STEP : (d + 1) * STEP])
    return out


def compressed(paths: list[tuple], left: int, right: int) -> list[dict]:
    """Edges of one range's tree. paths: sorted (path, chars, n, low, ends); left, right: turns shared with the neighbouring ranges; right is -1 in the last range.

    An edge stands for the nodes of depths top + 1 to top + len(saved); saved has one sum for each of them. Edges are cut
    where their nodes' kind changes, so that all nodes of an edge begin in this range (inner 1) or not (0), and are whole
    here (keys None) or shares (keys: digests of the nodes from the parent on).
    """
    first_keys, last_keys = _keys(paths[0][0], left), _keys(paths[-1][0], right)
    root = _Point(0, 0)
    stack, out = [root], []

    def close(point: _Point, parent: _Point, last: bool) -> None:
        if point.barren and not (last and right == point.depth):
            point.leaves = 1
        starts = {parent.depth} | {d for d in ((left,) if point.first == 0 else ()) + ((right,) if last else ()) if parent.depth < d < point.depth}
        saved, children, ends, end = point.saved, point.children, point.ends, point.depth
        lengths, low_key = paths[point.first][1], None
        for start in sorted(starts, reverse=True):
            known = first_keys if point.first == 0 and end <= left else last_keys if last and end <= right else None
            inner = 0 if point.first == 0 and end <= left else 1
            sums = []
            for d in range(end, start, -1):
                saved += (point.n - inner) * lengths[d - 1]
                sums.append(saved)
            keys = known[start : end + 1] if known else None
            if end == point.depth and known:
                point.key = known[end]
            edge = {"low": point.low, "top": start, "n": point.n, "leaves": point.leaves, "children": children, "inner": inner, "ends": ends, "saved": sums[::-1], "keys": keys}
            if low_key is not None:  # the part of the edge below hangs on this one
                low_key |= {"parent_low": None if known else point.low, "parent_key": known[end] if known else None}
            out.append((edge, parent if start == parent.depth else None))
            low_key, children, ends, end = edge, inner, None, start
        parent.add(point.n, point.low, point.leaves, children, saved)

    def fold(depth: int, last: bool = False) -> None:
        while stack[-1].depth > depth:
            top = stack.pop()
            if stack[-1].depth < depth:
                stack.append(_Point(depth, top.first))
            close(top, stack[-1], last)

    for k, (path, _, n, low, ends) in enumerate(paths):
        fold(_shared(paths[k - 1][0], path) if k else 0)
        if path:
            stack.append(_Point(len(path) // STEP, k, n, low, ends))
        else:
            root.n, root.low, root.ends = n, low, ends
    fold(0, last=True)
    if root.barren and right < 0:
        root.leaves = 1
    root.key = first_keys[0]
    rows = [edge | ({"parent_low": None if parent.key else parent.low, "parent_key": parent.key} if parent else {}) for edge, parent in out]
    return [*rows, {"low": root.low, "top": -1, "n": root.n, "leaves": root.leaves, "children": root.children, "inner": 0, "ends": root.ends, "saved": [root.saved], "keys": [b"", root.key], "parent_low": None, "parent_key": None}]


EDGE = "low long, top int, n long, leaves long, children long, inner int, ends string, saved array<long>, keys array<binary>, parent_low long, parent_key binary"
_ARROW = pa.schema([("low", pa.int64()), ("top", pa.int32()), ("n", pa.int64()), ("leaves", pa.int64()), ("children", pa.int64()), ("inner", pa.int32()), ("ends", pa.string()), ("saved", pa.list_(pa.int64())), ("keys", pa.list_(pa.binary())), ("parent_low", pa.int64()), ("parent_key", pa.binary())])


def compressed_edges(paths: DataFrame) -> DataFrame:
    """Edges of every range of `sorted_paths`, which has to be settled."""
    ends = paths.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"))

    @F.pandas_udf("int")
    def common(a, b):
        return a.combine(b, _shared)

    order = Window.orderBy("part")  # a row for each range
    ends = ends.select("part", "first", "last", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    ends = ends.select("part", common("before", "first").alias("left"), common("last", "after").alias("right"), F.col("after").isNull().alias("final"))

    def grow(rows: pa.Table) -> pa.Table:
        left, right = rows["left"][0].as_py(), rows["right"][0].as_py()
        listed = sorted(zip(*(rows[c].to_pylist() for c in ("path", "chars", "n", "low", "ends"))))
        # a last path of no turns has the next range's paths below it, if there is one
        return pa.Table.from_pylist(compressed(listed, left, -1 if rows["final"][0].as_py() else right), _ARROW)

    return paths.join(ends, "part").groupBy("part").applyInArrow(grow, EDGE)


def _nodes(edges: DataFrame, *more: Column) -> DataFrame:
    """A row for each node of an edge; `at` is its place there, from 0."""
    rows = edges.select("*", F.posexplode("saved").alias("at", "saved_tokens"))
    last = F.col("at") == F.size("saved") - 1
    return rows.select(
        F.col("low").alias("conv_id"), (F.col("top") + 1 + F.col("at")).cast("long").alias("depth"), F.when(F.col("at") == 0, F.col("parent_low")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.col("inner")).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), "saved_tokens", F.when(last, F.col("ends")).alias("ends"), *more,
    )


def trie_nodes(edges: DataFrame) -> DataFrame:
    """All nodes: unary ones come out of their edges, shares of one node are added up. edges has to be settled."""
    keyed = _nodes(edges.filter(F.col("keys").isNotNull()), F.element_at("keys", F.col("at") + 2).alias("key"), F.element_at("keys", F.col("at") + 1).alias("above"))
    total = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = settle(keyed.groupBy("key", "above", "depth").agg(F.min("conv_id").alias("conv_id"), *total, F.max("ends").alias("ends")), "spine")
    parents = spine.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    whole = edges.filter(F.col("keys").isNull())
    salted = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({"above": "parent_key", "parent_conv_id": "found"})
    # what hangs on a node of several ranges learns its parent's smallest id
    hanging = whole.filter(F.col("parent_key").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("low", "top"), F.lit(SALTS)).cast("int"))
    hanging = hanging.join(salted, ["parent_key", "salt"]).withColumn("parent_low", F.col("found")).select(*whole.columns)
    inside = _nodes(whole.filter(F.col("parent_key").isNull()).union(hanging))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")]
    return spine.join(parents, "above", "left").select(*columns).union(inside.select(*columns))


def prefix_trie(lists: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node over `turn_lists`."""
    return trie_nodes(settle(compressed_edges(settle(sorted_paths(lists), "paths")), "edges"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = settle(turn_lists(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "turns")
    return prefix_trie(settle(shared_heads(lists), "conversations"))


#: A node is told by the digest of its turns' digests; subtrees come from all pairs of a node and one above it.
OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM tab WHERE k < 8),
tb AS (SELECT list(v ORDER BY i) AS tb FROM tab WHERE k = 8),
t AS (SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sha, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS place, sha, chars FROM t),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS head,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, tb[1 + (xor(a, b) & 255)])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM p), tb),
r AS (SELECT i.conv_id, 0 AS own, place, sha, chars FROM ids i JOIN p ON p.conv_id = i.head AND place <= h UNION ALL SELECT i.conv_id, 1, place, sha, chars FROM ids i JOIN p ON p.conv_id = i.conv_id AND place > h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, sha, chars FROM r),
x AS (SELECT conv_id, depth, chars, sha256(string_agg(sha, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM s UNION ALL SELECT conv_id, 0, 0, 'root' FROM ids),
y AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS deepest, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM x),
n AS (SELECT node, any_value(above) AS above, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = deepest) AS ends FROM y GROUP BY node),
c AS (SELECT above AS node, count(*) AS n_children FROM n WHERE above IS NOT NULL GROUP BY above),
a AS (SELECT DISTINCT u.node AS top, v.node AS node FROM y u JOIN y v ON u.conv_id = v.conv_id AND u.depth <= v.depth),
b AS (SELECT a.top AS node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved FROM a JOIN n ON n.node = a.node LEFT JOIN c ON c.node = a.node GROUP BY a.top)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n LEFT JOIN n m ON m.node = n.above LEFT JOIN c ON c.node = n.node JOIN b ON b.node = n.node
"""
