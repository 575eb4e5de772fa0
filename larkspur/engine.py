"""Index, search and inspect projects: what the command line and other callers use."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import chunk, providers, text
from larkspur.operators import drift, index, metering, search, upkeep
from larkspur.sources import tree
from larkspur.sources.config import Config, Project
from larkspur.sources.shared import shared_dir
from larkspur.sources.store import Store

KINDS = ("code", "docs")
CHUNKS = "project string, kind string, id string, file_path string, chunk_index int, start_line int, end_line int, title string, version_id string, text string, content_hash string"
VECTORS = "model string, content_hash string, embedding array<float>"
MANIFEST = "project string, path string, file_path string, sha256 string"
MARKERS = "collection string, model string"
FACTS = "chain_key string, subject string, predicate string, object string, session_id string, version int, is_current boolean"
EXTRACTED = "text_sha string, model string, prompt_version string, triples array<struct<subject:string,predicate:string,object:string>>"
DOC_FACTS = "file_path string, subject string, predicate string, object string"
REPLIES = "judge_key string, reply string"


class Engine:
    """Tables of a store: chunks and manifest of each collection, vectors of each model, markers, facts of each project, caches."""

    def __init__(self, spark: SparkSession, config: Config, root: str, model: str = "hash-64", extractor: Callable | None = None, judge: Callable | None = None, buckets: int = 16, cap: int = metering.DAILY_CAP, prices: list[tuple[str, float, float]] = ()):
        """buckets: how many a new table has; a change writes whole buckets, so that large collections want many. cap: model
        calls a day; prices: (prefix of the model's name, dollars a million tokens in, out)."""
        self.spark, self.config, self.model = spark, config, model
        self.extractor, self.judge = extractor, judge
        self.store, self.queries = Store(spark, root, buckets), providers.QueryCache()
        self.ledger = metering.Ledger(self.store, cap, prices=prices)

    def _project(self, name: str) -> Project:
        if name not in self.config.projects:
            raise ValueError(f"unknown project {name!r}")
        return self.config.projects[name]

    def _collections(self) -> list[tuple[Project, str]]:
        return [(p, kind) for p in self.config.projects.values() for kind in KINDS]

    def _all(self, table: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        return reduce(DataFrame.union, (self.store.read(f"{table}/{p.collection(kind)}", schema) for p, kind in self._collections()), empty)

    def _vectors(self, model: str | None = None) -> DataFrame:
        """One vector for each text, though two writers may have stored the same."""
        return self.store.read(f"vectors/{model or self.model}", VECTORS).dropDuplicates(["content_hash"])

    def _roots(self, project: Project, kind: str) -> list[str]:
        return [d.path for d in project.code_dirs] if kind == "code" else [*project.docs_dirs, *(d.path for d in project.code_dirs)]

    def _files(self, project: Project, kind: str) -> DataFrame:
        if kind == "code":
            return tree.code_files(self.spark, project.code_dirs)
        files = tree.document_files(self.spark, project.docs_dirs, project.code_dirs)
        if files.filter("ext = '.pdf'").isEmpty():
            return files
        if not tree.reads_pdf():
            warnings.warn("PDF files are left out: reading them needs the optional library pymupdf", stacklevel=3)
            return files.filter("ext <> '.pdf'")
        return tree.with_pdf_texts(files)

    def _chunks_of(self, project: Project, kind: str, files: DataFrame) -> DataFrame:
        path = F.concat_ws("/", "root", "rel").alias("file_path")
        commits = {Path(d).name: sha for d in self._roots(project, kind) if kind == "code" and (sha := tree.head_commit(d))}
        version = F.coalesce(F.create_map(*[F.lit(x) for pair in commits.items() for x in pair])[F.col("root")], F.col("sha256")) if commits else F.col("sha256")
        base = files.select(path, "abs_path", "ext", "content", (F.col("mtime").cast("string") if kind == "docs" else version).alias("version_id"))
        if kind == "code":
            parsed = F.col("ext").isin(list(chunk.DECLARATIONS))
            made = chunk.line_windows(base.filter(~parsed), text="content")
            names = ["file_path", "version_id", "chunk_index", "start_line", "end_line", "chunk"]
            declared = base.filter(parsed).lateralJoin(chunk.DeclarationChunks(F.col("content").outer(), F.col("ext").outer()))
            made = made.select(*names).unionByName(declared.select(*names)).withColumn("title", F.lit(None).cast("string"))
        else:
            made = chunk.document_chunks(base, text="content").withColumns({"start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int")})
        made = made.withColumn("chunk", F.substring("chunk", 1, 2 * index.BATCH_TOKENS))  # cut before it is hashed
        return made.select(F.lit(project.name).alias("project"), F.lit(kind).alias("kind"), F.concat_ws(":", F.lit(kind), "file_path", F.col("chunk_index").cast("string")).alias("id"), "file_path", F.col("chunk_index").cast("int").alias("chunk_index"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "title", "version_id", F.col("chunk").alias("text"), text.content_hash(F.col("chunk")).alias("content_hash"))

    def _embed(self, texts: DataFrame) -> None:
        """Adds vectors of the texts (content_hash, text) that have none of the model; those of skipped batches stay out."""
        missing = texts.join(self._vectors().select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.first("text").alias("text"))
        if not missing.isEmpty():
            made = providers.embed_missing(missing, self.config.embed_provider, self.model).filter("embedding IS NOT NULL")
            self.store.append(f"vectors/{self.model}", VECTORS, made, ["content_hash"])

    def plan_model(self, project: Project) -> DataFrame:
        """What the configured model asks of the project's collections: keep, backfill, clear or blocked."""
        rows = []
        for kind in KINDS:
            roots = self._roots(project, kind)
            there = bool(roots) and all(Path(r).is_dir() for r in roots) and not self._files(project, kind).isEmpty()
            rows.append((project.collection(kind), kind, there))
        return upkeep.remodel_plan(self.spark.createDataFrame(rows, "collection string, kind string, roots_present boolean"), self.store.read("markers", MARKERS), self.model)

    def index(self, name: str | None = None) -> dict[str, str]:
        """Brings chunks, vectors and manifests up to date, then prunes what is gone in all projects.

        A collection whose vectors are of another model is built again, unless a root of it is missing. A root that is missing
        or empty keeps what it has. A project that can't be pruned doesn't keep others from it: the result has their errors.
        """
        for project in [self._project(name)] if name else list(self.config.projects.values()):
            plan = self.plan_model(project)
            decided = {r["kind"]: r["decision"] for r in plan.collect()}  # one row for each kind
            for kind in KINDS:
                if decided[kind] == "clear":
                    self.store.overwrite(f"manifest/{project.collection(kind)}", self.spark.createDataFrame([], MANIFEST), ["file_path"])
                if decided[kind] != "blocked":
                    self._index_kind(project, kind)
            markers = upkeep.remodel_record(self.store.read("markers", MARKERS), plan, self.model)
            if any(d != "keep" for d in decided.values()):
                self.store.overwrite("markers", markers)
        failed = {}
        for project, kind in self._collections():
            try:
                self._prune(project, kind, self._files(project, kind))
            except Exception as e:  # noqa: BLE001 - told in the result, and the others go on
                failed[project.collection(kind)] = str(e)
        return failed

    def _index_kind(self, project: Project, kind: str) -> None:
        place, files = project.collection(kind), self._files(project, kind)
        if files.isEmpty():
            return
        manifest, stored = self.store.read(f"manifest/{place}", MANIFEST), self.store.read(f"chunks/{place}", CHUNKS)
        state = index.manifest_diff(files.select(F.col("abs_path").alias("path"), "sha256"), manifest)
        healed = index.not_indexed(manifest.select("path", "file_path"), stored).select("path")
        todo_paths = state.filter("state IN ('new', 'changed')").select("path").union(healed).distinct().withColumnRenamed("path", "abs_path")
        todo = files.join(todo_paths, "abs_path", "left_semi")
        if todo.isEmpty():
            return
        fresh = self._chunks_of(project, kind, todo).cache()
        # read more than once by every change of a table; without it, each would scan the sources again
        done = todo.select(F.concat_ws("/", "root", "rel").alias("file_path"), F.col("abs_path").alias("path"), "sha256").cache()
        try:
            self._embed(fresh.select("content_hash", "text"))
            expected = done.select("file_path").join(fresh.groupBy("file_path").agg(F.countDistinct("id").alias("n")), "file_path", "left").fillna(0, ["n"])
            with_vector = fresh.join(self._vectors().select("content_hash"), "content_hash", "left_semi")
            complete = index.complete_files(expected, with_vector)
            self.store.replace(f"chunks/{place}", CHUNKS, fresh, done, ["file_path"])
            # the manifest comes last: a file counts as indexed once all of its chunks have vectors
            rows = done.join(complete, "file_path", "left_semi").select(F.lit(place).alias("project"), "path", "file_path", "sha256")
            self.store.replace(f"manifest/{place}", MANIFEST, rows, done, ["file_path"])
        finally:
            fresh.unpersist()
            done.unpersist()

    def _prune(self, project: Project, kind: str, files: DataFrame) -> None:
        """Chunks and manifest rows go of files that no scan of their root takes any more: deleted, excluded, moved out of scope, or
        .md in a code collection. Roots that are missing, empty or share their name with another keep theirs."""
        place = project.collection(kind)
        stored, manifest = self.store.read(f"chunks/{place}", CHUNKS), self.store.read(f"manifest/{place}", MANIFEST)
        if stored.isEmpty() and manifest.isEmpty():
            return
        scanned = {r["root"] for r in files.select("root").distinct().collect()}  # one row for each configured folder
        roots = [(Path(d).name, d, Path(d).name in scanned) for d in dict.fromkeys(str(Path(r).resolve()) for r in self._roots(project, kind))]
        known = self.spark.createDataFrame(roots or [("", "", False)], "name string, path string, exists boolean")
        present = files.select(F.concat_ws("/", "root", "rel").alias("file_path"))
        gone = index.deleted_sources(stored.select("file_path").union(manifest.select("file_path")).distinct(), known, present).cache()
        try:
            if not gone.isEmpty():
                self.store.delete(f"chunks/{place}", CHUNKS, gone, ["file_path"])
                self.store.delete(f"manifest/{place}", MANIFEST, gone, ["file_path"])
        finally:
            gone.unpersist()

    def index_document(self, name: str, path: str) -> None:
        """One file, whatever its folder's rules leave out: its chunks take the place of those it had."""
        project, real = self._project(name), Path(path).resolve()
        roots = [(Path(r).resolve().name, str(Path(r).resolve()), k) for k, r in enumerate(self._roots(project, "docs"))]
        files = self.spark.createDataFrame([(str(real),)], "abs_path string")
        owned = upkeep.owning_root(files, self.spark.createDataFrame(roots or [("", "\n", 0)], "name string, path string, place int")).first()
        if owned is None:
            raise ValueError(f"{path} is in no folder of {name}")
        one = tree.read_tree(self.spark, str(real.parent), [real.suffix]).filter(F.col("abs_path") == str(real)).withColumns({"root": F.lit(owned["name"]), "rel": F.lit(owned["rel"])})
        place, fresh = project.collection("docs"), self._chunks_of(project, "docs", one).cache()
        try:
            self._embed(fresh.select("content_hash", "text"))
            own = F.concat_ws("/", F.lit(owned["name"]), F.lit(owned["rel"]))
            self.store.replace(f"chunks/{place}", CHUNKS, fresh, one.select(own.alias("file_path")), ["file_path"])
            rows = one.select(F.lit(place).alias("project"), F.col("abs_path").alias("path"), own.alias("file_path"), "sha256")
            self.store.replace(f"manifest/{place}", MANIFEST, rows, rows, ["file_path"])
        finally:
            fresh.unpersist()

    def search(self, queries: list[str], n: int = 5, project: str | None = None, kind: str | None = None, path_filter: str | None = None) -> DataFrame:
        """(query_id, rank, id, score, distance, project, kind, file_path, version_id, text). An unknown project means all of them.

        Targets go in the order of the config. One whose vectors are of another model is searched by keywords alone.
        """
        named = [project] if project in self.config.projects else list(self.config.projects)
        targets = [(p.name, k, p.collection(k)) for p, k in self._collections() if p.name in named and kind in (None, k)]
        chunks = self._all("chunks", CHUNKS)
        whole = F.concat_ws("|", "project", F.col("id")).alias("id")
        got = self.queries.embed(providers.provider(self.config.embed_provider), queries, self.model)
        asked = self.spark.createDataFrame([(k, q, [float(x) for x in v]) for k, (q, v) in enumerate(zip(queries, got, strict=True))], "query_id long, text string, embedding array<double>")
        if not targets:
            return self.spark.createDataFrame([], "query_id long, rank int, id string, score double, distance double, project string, kind string, file_path string, version_id string, text string")
        sided = upkeep.model_interlock(self.spark.createDataFrame(targets, "project string, kind string, collection string"), self.store.read("markers", MARKERS), self.model)
        usable = {r["collection"]: r["vector_side"] for r in sided.collect()}  # one row for each target
        vectors, frames = self._vectors().select("content_hash", "embedding"), []
        for _, _, place in targets:
            rows = self.store.read(f"chunks/{place}", CHUNKS)
            rows = rows.join(vectors, "content_hash", "left") if usable[place] else rows.withColumn("embedding", F.lit(None).cast("array<float>"))
            frames.append(rows.select(whole, "text", "embedding", F.col("file_path").alias("path")))
        hits = search.search(frames, asked, n, path_filter=path_filter)
        return hits.join(chunks.select(whole, "project", "kind", "file_path", "version_id", "text"), "id").orderBy("query_id", "rank")

    def result_texts(self, hits: DataFrame, longest: int = 2000) -> DataFrame:
        """(query_id, rank, shown): the hits of search() as blocks of text for a reader."""
        collection = F.concat_ws("-", "project", "kind")
        return hits.select("query_id", "rank", text.result_text(F.col("rank"), F.col("project"), collection, F.col("file_path"), F.col("distance"), F.col("version_id"), F.col("text"), longest).alias("shown"))

    def status(self) -> DataFrame:
        return index.status(self._all("chunks", CHUNKS))

    def tracked_files(self) -> int:
        return index.tracked_files(self._all("manifest", MANIFEST)).first()["n"]

    def stale_rates(self) -> DataFrame:
        """(project, kind, fresh, stale, unknown, rate) of every collection against its sources as they are."""
        parts = [self._files(p, kind).select(F.concat_ws("/", "root", "rel").alias("file_path"), F.lit(kind).alias("kind"), "root", "sha256", "mtime") for p, kind in self._collections()]
        commits = [(Path(d.path).name, tree.head_commit(d.path)) for p in self.config.projects.values() for d in p.code_dirs]
        known = self.spark.createDataFrame([(p.name, kind) for p, kind in self._collections()], "project string, kind string")
        versions = upkeep.current_versions(reduce(DataFrame.union, parts), self.spark.createDataFrame(commits or [("", None)], "root string, sha string"))
        return upkeep.collection_stale_rates(self._all("chunks", CHUNKS), versions.dropDuplicates(["file_path", "kind"]), known)

    def build_shadow(self, name: str, kind: str, model: str, suffix: str) -> DataFrame:
        """A copy of a collection under another model, (id, text, embedding), at {collection}-{suffix}; goes on where it ended."""
        place, schema = self._project(name).collection(kind), "id string, text string, embedding array<float>"
        have = self.store.read(f"shadow/{place}-{suffix}", schema)
        todo = upkeep.shadow_missing(self.store.read(f"chunks/{place}", CHUNKS), have).select(F.col("id").alias("content_hash"), "text")
        made = providers.embed_missing(todo, self.config.embed_provider, model).filter("embedding IS NOT NULL")
        self.store.append(f"shadow/{place}-{suffix}", schema, made.join(todo, "content_hash").select(F.col("content_hash").alias("id"), "text", "embedding"), ["id"])
        return self.store.read(f"shadow/{place}-{suffix}", schema)

    def prose_drift(self, name: str) -> drift.Drift:
        """Where the indexed documents of a project contradict its current facts (table facts/{project}, FACTS).

        Raises ValueError with the reason that preflight() names. Every call of extractor or judge is booked in the ledger
        before it is made, and kept when it is done; where the day's cap doesn't allow all, the result is a partial one.
        """
        if reason := drift.preflight(name, {p.name: p.prose_drift_enabled for p in self.config.projects.values()}, self.extractor, self.judge):
            raise ValueError(reason)
        capped = []

        def grant(asked: DataFrame) -> DataFrame:
            booked = self.ledger.book(asked, self.model)
            capped.append(booked.count() < asked.distinct().count())
            return booked

        def keep(table: str, schema: str, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
            def stored(new: DataFrame) -> DataFrame:
                new = new.checkpoint()  # asked once, whatever reads it
                self.store.upsert(table, schema, new.select(*[c.split()[0] for c in schema.split(", ")]), keys, by=keys[:1])
                self.ledger.done(new.select(F.col(keys[0]).alias("call_key"), "input_tokens", "output_tokens"))
                return new

            return stored

        shared_dir(self.spark)
        docs = upkeep.indexed_documents(self.store.read(f"chunks/{self._project(name).collection('docs')}", CHUNKS))
        claims, _ = drift.extract_cached(docs, self.store.read("extracted", EXTRACTED), self.extractor, self.model, grant=grant, keep=keep("extracted", EXTRACTED, ["text_sha", "model", "prompt_version"]))
        worded = lambda df: df.withColumn("fact", text.fact_text(F.col("subject"), F.col("predicate"), F.col("object"))).withColumn("content_hash", text.content_hash(F.col("fact")))
        self.store.overwrite(f"doc_facts/{name}", claims.select([c.split()[0] for c in DOC_FACTS.split(", ")]), ["file_path"])
        claims = worded(self.store.read(f"doc_facts/{name}", DOC_FACTS))
        facts = worded(self.store.read(f"facts/{name}", FACTS).filter("is_current"))
        self._embed(claims.select("content_hash", F.col("fact").alias("text")).union(facts.select("content_hash", "fact")))
        vectors = self._vectors().select("content_hash", "embedding")
        found = drift.scan(claims.join(vectors, "content_hash").withColumnRenamed("file_path", "source"), facts.join(vectors, "content_hash"), docs, self.store.read("replies", REPLIES), self.judge, 0, model=self.model, grant=grant, keep=keep("replies", REPLIES, ["judge_key"]))
        return found._replace(counters=found.counters.withColumn("cap_hit", F.col("cap_hit") | F.lit(any(capped))))

    def add_document(self, name: str, title: str, content: str) -> str:
        """Writes {slug}.md to the project's first docs folder and indexes it; the file stays if that fails."""
        project = self._project(name)
        if not content.strip():
            raise ValueError("no content")
        if not project.docs_dirs:
            raise ValueError(f"{name} has no docs folder")
        slug = self.spark.range(1).select(text.slugify(F.lit(title))).first()[0]
        path = Path(project.docs_dirs[0], f"{slug}.md")
        path.write_text(content)
        self.index_document(name, str(path))
        return str(path)
