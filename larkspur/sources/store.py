"""Tables that change, on plain Parquet: rows lie in buckets by a hash of their key, a change writes the buckets that it
touches, and a numbered commit names the files that count.

    {table}/data/bucket__=7/version__=<id>/part-*.parquet    files of one bucket, written by one change
    {table}/000000000012.commit                              JSON: the key, and the versions of every bucket
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.operators import index

#: Commits of a table that stay, the newest among them, with the files that they name.
KEPT = 3
#: Versions of a bucket from which the next append writes the bucket anew.
MOST_VERSIONS = 8
#: Times that a change is made again on what another writer has committed meanwhile.
TRIES = 10
BUCKET, VERSION = "bucket__", "version__"
_COMMIT = re.compile(r"(\d{12})\.commit")


class Conflict(RuntimeError):
    """Another writer committed this number first."""


class State(NamedTuple):
    """What a commit says: its number, the columns whose hash is the bucket (none: one bucket), and the versions of each bucket."""

    number: int
    by: list[str]
    buckets: int
    parts: dict[int, list[str]]


class Store:
    """Any number of writers: a commit is made by one of them, the others redo their change on top of it. Readers see the
    last commit, whole. Paths may be on any file system that Spark reads and that refuses to rename onto a file."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _named(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def commits(self, name: str) -> list[int]:
        return sorted(int(m[1]) for f in self._named(f"{self.root}/{name}") if (m := _COMMIT.fullmatch(f)))

    def state(self, name: str, number: int | None = None) -> State | None:
        """The newest commit, or the one of a number."""
        if number is None:
            found = self.commits(name)
            if not found:
                return None
            number = found[-1]
        fs, p = self._fs(f"{self.root}/{name}/{number:012d}.commit")
        source = fs.open(p)
        try:
            said = json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()
        return State(number, said["by"], said["buckets"], {int(b): v for b, v in said["parts"].items()})

    def snapshot(self, name: str) -> int | None:
        found = self.commits(name)
        return found[-1] if found else None

    def read(self, name: str, schema: str) -> DataFrame:
        return self._read(name, schema, self.state(name))

    def read_bucketed(self, name: str, schema: str) -> DataFrame:
        """As read, with the bucket of each row, so that a join or filter on it reads the files of those buckets alone."""
        return self._read(name, schema, self.state(name), bucket=True)

    def _read(self, name: str, schema: str, state: State | None, only: list[int] | None = None, bucket: bool = False) -> DataFrame:
        paths = [f"{self.root}/{name}/data/{BUCKET}={b}/{VERSION}={v}" for b, versions in (state.parts if state else {}).items() if only is None or b in only for v in versions]
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromDDL(schema)] + [f"{BUCKET} int"]
        if paths:
            df = self.spark.read.schema(", ".join([*columns, f"{VERSION} string"])).option("basePath", f"{self.root}/{name}/data").parquet(*paths).drop(VERSION)
        else:
            df = self.spark.createDataFrame([], ", ".join(columns))
        return df if bucket else df.drop(BUCKET)

    @staticmethod
    def bucket(by: list[str], buckets: int) -> Column:
        """The bucket of a row: any writer and reader has to agree on it. One column of whole numbers is the bucket itself where it is named bucket_."""
        if by == ["bucket_"]:
            return F.pmod(F.col("bucket_"), F.lit(buckets)).cast("int")
        return F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int") if by else F.lit(0)

    def _write(self, name: str, df: DataFrame, by: list[str], buckets: int) -> dict[int, str]:
        """Files of a new version of the buckets that df has rows of. No commit names them yet."""
        version = uuid.uuid4().hex
        staged = f"{self.root}/{name}/staged-{version}"
        rows = df.withColumn(BUCKET, self.bucket(by, buckets))
        # one file for each bucket, more where adaptive execution finds it large; without a key, files are those of the tasks
        # and the codec of Parquet files by default takes memory outside the heap for every file, this one does not
        (rows.hint("rebalance", BUCKET) if by else rows).write.option("compression", "zstd").partitionBy(BUCKET).parquet(staged)
        fs, top = self._fs(staged)
        made = {}
        for folder in self._named(staged):
            if folder.startswith(f"{BUCKET}="):
                target = self._fs(f"{self.root}/{name}/data/{folder}")[1]
                fs.mkdirs(target)
                if not fs.rename(self._fs(f"{staged}/{folder}")[1], self._fs(f"{self.root}/{name}/data/{folder}/{VERSION}={version}")[1]):
                    raise OSError(f"{staged}/{folder} can't be moved")
                made[int(folder.partition("=")[2])] = version
        fs.delete(top, True)
        return made

    def _publish(self, name: str, state: State) -> None:
        """Writes the commit under another name and gives it its own in one step, which fails where the number is taken."""
        said = json.dumps({"by": state.by, "buckets": state.buckets, "parts": state.parts}).encode()
        final, draft = f"{self.root}/{name}/{state.number:012d}.commit", f"{self.root}/{name}/{uuid.uuid4().hex}.draft"
        fs, p = self._fs(draft)
        fs.mkdirs(self._fs(f"{self.root}/{name}")[1])
        jvm = self.spark.sparkContext._jvm
        if fs.getScheme() == "file":  # a rename would replace the file there, a link doesn't
            at = p.toUri().getPath()
            with open(at, "wb") as f:
                f.write(said)
            try:
                os.link(at, self._fs(final)[1].toUri().getPath())
            except FileExistsError:
                raise Conflict(final) from None
            finally:
                os.unlink(at)
            return
        out = fs.create(p, False)
        out.write(said)
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(p, self._fs(final)[1], options)
        except Exception as e:
            fs.delete(p, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(final) from None
            raise

    def _forget(self, name: str, parts: dict[int, str] | set[tuple[int, str]]) -> None:
        for b, v in parts.items() if isinstance(parts, dict) else parts:
            fs, p = self._fs(f"{self.root}/{name}/data/{BUCKET}={b}/{VERSION}={v}")
            fs.delete(p, True)

    def _clean(self, name: str) -> None:
        """Commits before the KEPT newest go, and the files that only they name."""
        found = self.commits(name)
        if len(found) <= KEPT:
            return
        named = lambda numbers: {(b, v) for n in numbers for b, versions in self.state(name, n).parts.items() for v in versions}
        with contextlib.suppress(Exception):  # another writer may clean the same files
            self._forget(name, named(found[:-KEPT]) - named(found[-KEPT:]))
            for n in found[:-KEPT]:
                fs, p = self._fs(f"{self.root}/{name}/{n:012d}.commit")
                fs.delete(p, False)

    def change(self, name: str, schema: str | None, by: list[str], touched: DataFrame | None, make: Callable[[DataFrame | None], DataFrame]) -> int | None:
        """Puts make(rows of the touched buckets) in place of these buckets. touched has the columns `by` of all rows that make
        adds, drops or changes; None stands for all buckets, whose number and key are then set anew. Without a schema make gets
        no rows. Nothing is written where nothing is touched. Returns the number of the commit.
        """
        for _ in range(TRIES):
            state = self.state(name)
            if touched is None or state is None:
                own = State(state.number if state else 0, list(by), self.buckets if by else 1, {})
                only, before = None, self._read(name, schema, state) if schema else None
            else:
                own = state
                rows = touched.select(self.bucket(state.by, state.buckets).alias(BUCKET)).distinct().collect()  # as many as there are buckets at most
                only = [r[BUCKET] for r in rows]
                if not only:
                    return None
                before = self._read(name, schema, state, only)
            made = self._write(name, make(before), own.by, own.buckets)
            parts = {b: v for b, v in own.parts.items() if only is not None and b not in only} | {b: [v] for b, v in made.items()}
            try:
                self._publish(name, State(own.number + 1, own.by, own.buckets, parts))
            except Conflict:
                self._forget(name, made)
                continue
            self._clean(name)
            return own.number + 1
        raise Conflict(f"{name}: {TRIES} other writers were first")

    def overwrite(self, name: str, df: DataFrame, by: list[str] = ()) -> int:
        """df in place of the whole table. It doesn't look at what is there, so the last writer's rows count."""
        return self.change(name, None, list(by), None, lambda _: df)

    def append(self, name: str, schema: str, new: DataFrame, by: list[str], after: int | None = None) -> int:
        """Adds rows whose keys the caller knows to be new: their files come beside those of their buckets, which aren't read
        unless there are too many files. Of two writers both rows stay; with `after`, the number of the commit that the
        caller has seen (0: none), it is a conflict where there is a newer one."""
        made = None
        for _ in range(TRIES):
            state = self.state(name)
            if after is not None and (state.number if state else 0) != after:
                raise Conflict(name)
            state = state or State(0, list(by), self.buckets if by else 1, {})
            made = made or self._write(name, new, state.by, state.buckets)
            if not made:
                return state.number
            full = [b for b in made if len(state.parts.get(b, ())) >= MOST_VERSIONS]
            anew = self._write(name, self._read(name, schema, state, full), state.by, state.buckets) if full else {}
            parts = dict(state.parts) | {b: [*([anew[b]] if b in anew else state.parts.get(b, [])), v] for b, v in made.items()}
            try:
                self._publish(name, State(state.number + 1, state.by, state.buckets, parts))
            except Conflict:
                self._forget(name, anew)
                continue
            self._clean(name)
            return state.number + 1
        raise Conflict(f"{name}: {TRIES} other writers were first")

    def upsert(self, name: str, schema: str, new: DataFrame, keys: list[str], order: str | None = None, by: list[str] | None = None) -> int | None:
        """new's rows in place of those with equal keys; see index.upsert. The table's buckets are by `by`, which are some of the keys."""
        by = keys if by is None else by
        return self.change(name, schema, by, new.select(*by), lambda before: index.upsert(before, new.select(*before.columns, *([order] if order and order not in before.columns else [])), keys, order).select(*before.columns))

    def replace(self, name: str, schema: str, new: DataFrame, gone: DataFrame, keys: list[str]) -> int | None:
        """Rows whose keys are among gone's go, and new's come. keys are the bucket's columns."""
        touched = reduce(DataFrame.union, (df.select(*keys) for df in (gone, new)))
        return self.change(name, schema, keys, touched, lambda before: before.join(gone.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*before.columns)))

    def delete(self, name: str, schema: str, gone: DataFrame, keys: list[str]) -> int | None:
        return self.change(name, schema, keys, gone.select(*keys), lambda before: before.join(gone.select(*keys).distinct(), keys, "left_anti"))
