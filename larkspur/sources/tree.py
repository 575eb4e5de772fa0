"""Source trees as tables: a Python data source, since Spark's own file source leaves out names that begin with _ or a dot."""

from __future__ import annotations

import hashlib
import importlib.util
import os
import subprocess
import time
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

FILES = "root string, rel string, abs_path string, ext string, sha256 string, mtime double, content string"
DOCUMENT_ENDS = (".md", ".txt", ".pdf")


def is_hidden(parts: tuple[str, ...]) -> bool:
    """Whether a folder on the way to the file is hidden; a hidden file in open folders isn't."""
    return any(p.startswith(".") for p in parts[:-1])


class Scan(NamedTuple):
    """What files of a root are taken: of the extensions, in an included folder if any is given, in no excluded or hidden one."""

    root: str
    extensions: tuple[str, ...]
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def starts(self) -> list[str]:
        """Folders to begin in; one inside another is not begun in twice."""
        top = Path(self.root).resolve()
        found = sorted({(top / d) for d in self.include if (top / d).is_dir()}) if self.include else [top]
        return [str(f) for f in found if not any(f != g and f.is_relative_to(g) for g in found)]

    def takes(self, path: Path) -> bool:
        top = Path(self.root).resolve()
        return path.suffix in self.extensions and not is_hidden(path.relative_to(top).parts) and not any(path.resolve().is_relative_to((top / d).resolve()) for d in self.exclude)

    def folders(self, folder: str) -> tuple[list[str], list[str]]:
        """Open folders and names of files of one folder, in order."""
        inner, names = [], []
        with os.scandir(folder) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    if not e.name.startswith("."):
                        inner.append(e.path)
                else:
                    names.append(e.name)
        return sorted(inner), sorted(names)

    def files(self, folder: str, deep: bool) -> Iterator[Path]:
        """Files of a folder, and of those below it if deep. A folder that is gone has none."""
        try:
            inner, names = self.folders(folder)
        except OSError:
            return
        for name in names:
            if self.takes(path := Path(folder, name)):
                yield path
        for f in inner if deep else ():
            yield from self.files(f, True)


def walk(root: str, extensions: list[str], include: list[str] = (), exclude: list[str] = ()) -> Iterator[Path]:
    """Files of a scan, in order of their folders."""
    scan = Scan(root, tuple(extensions), tuple(include), tuple(exclude))
    for start in scan.starts():
        yield from scan.files(start, True)


class _Part(InputPartition):
    """A folder to list on an executor, with all below it or alone; of its files those of one share. since, upto: times of change."""

    def __init__(self, folder: str, deep: bool, share: int = 0, shares: int = 1, since: float | None = None, upto: float | None = None):
        self.folder, self.deep, self.share, self.shares, self.since, self.upto = folder, deep, share, shares, since, upto


class _Lister:
    """Cuts a scan into folders, and reads the files of one. The driver lists folders only until there are enough of them."""

    def __init__(self, options: dict):
        split = lambda k: tuple(x for x in options.get(k, "").split(",") if x)
        self.scan = Scan(str(Path(options["path"]).resolve()), split("extensions"), split("include"), split("exclude"))
        self.enough, self.size = int(options.get("folders", 64)), int(options.get("filesPerPartition", 200))

    def parts(self, since: float | None = None, upto: float | None = None) -> list[_Part]:
        waiting, done = [f for f in self.scan.starts() if os.path.isdir(f)], []
        while waiting and len(waiting) + len(done) < self.enough:
            folder = waiting.pop(0)
            try:
                inner, names = self.scan.folders(folder)
            except OSError:
                continue
            shares = -(-len(names) // self.size)
            done += [_Part(folder, False, k, shares, since, upto) for k in range(shares)]
            waiting += inner
        return [*done, *(_Part(f, True, since=since, upto=upto) for f in waiting)] or [_Part(self.scan.root, False, 0, 1, since, since)]

    def rows(self, part: _Part) -> Iterator[tuple]:
        root = self.scan.root
        for path in self.scan.files(part.folder, part.deep):
            if part.shares > 1 and int(hashlib.md5(path.name.encode("utf-8", "surrogateescape")).hexdigest()[:8], 16) % part.shares != part.share:
                continue
            try:
                stat = path.stat()
                changed = max(stat.st_mtime, stat.st_ctime)  # a file moved here keeps its time of change, but not that of its entry
                if (part.since is not None and changed <= part.since) or (part.upto is not None and changed > part.upto):
                    continue
                raw = path.read_bytes()
            except OSError:
                continue  # gone since it was listed
            yield os.path.basename(root), path.relative_to(root).as_posix(), str(path), path.suffix, hashlib.sha256(raw).hexdigest(), stat.st_mtime, raw.decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.lister = _Lister(options)

    def partitions(self):
        return self.lister.parts()

    def read(self, partition):
        return self.lister.rows(partition)


class _Stream(DataSourceStreamReader):
    """Files as they are added or changed: an offset is a time, and a batch has what changed after one and up to the other.
    Files of the last `lag` seconds wait for the next batch, as they may still be written."""

    def __init__(self, options: dict):
        self.lister, self.lag = _Lister(options), float(options.get("lag", 1.0))

    def initialOffset(self) -> dict:
        return {"upto": 0.0}

    def latestOffset(self) -> dict:
        return {"upto": time.time() - self.lag}

    def partitions(self, start: dict, end: dict):
        return self.lister.parts(start["upto"], end["upto"])

    def read(self, partition):
        return self.lister.rows(partition)


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("extensions", ".py,.cs").load(root), or readStream. Further options: include,
    exclude, folders (that the driver lists at most), filesPerPartition, lag.

    The extensions are an option, as filters aren't pushed into the reader: Spark 4.1 keeps the filters that a Python source
    has taken for all scans of it in a plan, so that a union of two differently filtered halves would lose rows.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema):
        return _Reader(dict(self.options))

    def streamReader(self, schema):
        return _Stream(dict(self.options))


def stream_tree(spark: SparkSession, root: str, extensions: list[str], lag: float = 1.0) -> DataFrame:
    """Files of a tree as a stream."""
    spark.dataSource.register(SourceTree)
    return spark.readStream.format("source_tree").option("extensions", ",".join(extensions)).option("lag", str(lag)).load(str(root))


def read_tree(spark: SparkSession, root: str, extensions: list[str], include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").option("extensions", ",".join(extensions)).option("include", ",".join(include)).option("exclude", ",".join(exclude)).load(str(root))


def code_files(spark: SparkSession, code_dirs: list) -> DataFrame:
    """Files of all code folders; .md is never code, and a folder that doesn't exist has none."""
    out = spark.createDataFrame([], FILES)
    for d in code_dirs:
        if Path(d.path).is_dir():
            out = out.union(read_tree(spark, d.path, [e for e in d.extensions if e != ".md"], d.include_dirs, d.exclude_dirs))
    return out


def document_files(spark: SparkSession, docs_dirs: list[str], code_dirs: list) -> DataFrame:
    """Documents of docs folders and .md of code folders; a file in both is the docs folder's, each file once."""
    out = spark.createDataFrame([], FILES).withColumn("priority", F.lit(0))
    for k, d in enumerate(docs_dirs):
        if Path(d).is_dir():
            out = out.union(read_tree(spark, d, list(DOCUMENT_ENDS)).withColumn("priority", F.lit(k)))
    for k, d in enumerate(code_dirs):
        if Path(d.path).is_dir():
            out = out.union(read_tree(spark, d.path, [".md"], d.include_dirs, d.exclude_dirs).withColumn("priority", F.lit(len(docs_dirs) + k)))
    first = F.row_number().over(Window.partitionBy("abs_path").orderBy("priority"))
    return out.withColumn("__n", first).filter("__n = 1").drop("__n", "priority")


def pdf_text(path: str) -> str:
    """Page texts joined by a blank line. Needs the optional library pymupdf."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional library pymupdf") from e
    with pymupdf.open(path) as pages:
        return "\n\n".join(p.get_text() for p in pages)


def reads_pdf() -> bool:
    return importlib.util.find_spec("pymupdf") is not None


def with_pdf_texts(files: DataFrame) -> DataFrame:
    """files with the text of PDF files as their content, read on the executors."""

    def run(frames):
        for frame in frames:
            yield frame.assign(content=[pdf_text(p) if e == ".pdf" else c for p, e, c in zip(frame["abs_path"], frame["ext"], frame["content"], strict=True)])

    return files.mapInPandas(run, files.schema)


def head_commit(root: str) -> str | None:
    """The commit that a folder's repository is at, or None."""
    try:
        done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() if done.returncode == 0 else None
