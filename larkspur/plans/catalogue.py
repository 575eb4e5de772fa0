"""Registered queries of the engine proper, each with the SQL that it is held against.

Search queries take the benchmark's passages as query texts, and as vectors those of every hundredth id or of the
passage's own number; documents and vectors meet where doc_id = vec_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import chunk, text
from larkspur.operators import bm25, drift, evals, facts, fusion, index, metering, search, vector
from larkspur.operators.keyword_index import KeywordIndex
from larkspur.operators.vector_index import VectorIndex, recall
from larkspur.sources.shared import built_once, session_store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from larkspur.plans import upkeep  # noqa: F401 - registers its queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL) if queries() else {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("path"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def keyword_index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """Stored postings of all documents; queries of one session over the same table share them."""

    def build(store) -> KeywordIndex:
        made = KeywordIndex(store, "documents")
        made.build(documents(spark, sf_dir))
        return made

    return built_once(spark, "keywords", f"{sf_dir}/documents.parquet", build)


def tokens_sql(source: str) -> str:
    """Rows (id, ord, term) of source, which has id and text."""
    return f"""(SELECT id, word_at, unnest(CASE WHEN regexp_matches(word, '[A-Za-z0-9]') THEN list_transform(regexp_extract_all(regexp_replace(word, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)) ELSE [lower(word)] END) AS token
  FROM (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS word_at FROM (SELECT id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS ws FROM {source})))"""


def terms_sql(source: str) -> str:
    return f"(SELECT id, strip_accents(token) AS term FROM {tokens_sql(source)} WHERE NOT regexp_matches(token, '^_+$'))"


DOCS_SQL = "(SELECT doc_id AS id, text, source AS path FROM documents)"
ITEMS_SQL = "(SELECT item_id AS id, text FROM benchmark)"


def bm25_sql(n: int, items: str = ITEMS_SQL, keep: str = "true") -> str:
    """CTEs ending in ranked(query_id, id, score, rank)."""
    return f"""tok AS (SELECT * FROM {terms_sql(DOCS_SQL)}),
post AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.doc_id AS id, d.source AS path, coalesce(n, 0) AS dl FROM documents d LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) t ON t.id = d.doc_id),
stat AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
q AS (SELECT id AS query_id, term, count(*) AS times FROM {terms_sql(items)} GROUP BY ALL),
scored AS (SELECT query_id, post.id, round(sum(times * CASE WHEN (n_docs - df + 0.5) / (df + 0.5) > 1 THEN ln((n_docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM q JOIN df USING (term) JOIN post USING (term) JOIN dl ON dl.id = post.id, stat WHERE {keep} GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored) WHERE rank <= {n})"""


def knn_sql(n: int, metric: str = "l2", queries: str = "SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0", keep: str = "true") -> str:
    """CTEs ending in near(query_id, id, distance, rank)."""
    pair = "list_sum(list_transform(range(1, len(qv) + 1), lambda i: (qv[i]::DOUBLE - embedding[i]) * (qv[i]::DOUBLE - embedding[i])))"
    if metric == "cosine":
        dot = "list_sum(list_transform(range(1, len(qv) + 1), lambda i: {}[i]::DOUBLE * {}[i]))"
        pair = f"1 - {dot.format('qv', 'embedding')} / (sqrt({dot.format('qv', 'qv')}) * sqrt({dot.format('embedding', 'embedding')}))"
    return f"""qs AS ({queries}),
dist AS (SELECT query_id, vec_id AS id, round({pair}, 6) + 0.0 AS distance FROM qs, embeddings WHERE {keep}),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM dist) WHERE rank <= {n})"""


@query("tokenize_code_aware", f"SELECT d.id, coalesce(count(token), 0)::BIGINT AS n_tokens, coalesce(string_agg(token, ' ' ORDER BY word_at, part), '') AS tokens FROM {DOCS_SQL} d LEFT JOIN (SELECT *, row_number() OVER () AS part FROM {tokens_sql(DOCS_SQL)}) t ON t.id = d.id GROUP BY d.id")
def tokenize_code_aware(spark, sf_dir):
    made = documents(spark, sf_dir).select("id", text.tokens(F.col("text")).alias("t"))
    return made.select("id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("term_frequencies", f"SELECT term, count(*)::BIGINT AS tf, count(DISTINCT id)::BIGINT AS df FROM {terms_sql(DOCS_SQL)} GROUP BY term")
def term_frequencies(spark, sf_dir):
    return bm25.postings(documents(spark, sf_dir)).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("doc_lengths", f"SELECT d.id, count(term)::BIGINT AS dl FROM {DOCS_SQL} d LEFT JOIN {terms_sql(DOCS_SQL)} t ON t.id = d.id GROUP BY d.id")
def doc_lengths(spark, sf_dir):
    return bm25.doc_lengths(documents(spark, sf_dir))


@query("corpus_stats", f"SELECT count(*)::BIGINT AS n_docs, round(avg(dl), 9) AS avgdl FROM (SELECT d.id, count(term) AS dl FROM {DOCS_SQL} d LEFT JOIN {terms_sql(DOCS_SQL)} t ON t.id = d.id GROUP BY d.id)")
def corpus_stats(spark, sf_dir):
    return bm25.corpus_stats(bm25.doc_lengths(documents(spark, sf_dir))).withColumn("avgdl", F.round("avgdl", 9))


@query("bm25_topk", f"WITH {bm25_sql(10)} SELECT query_id, id, score, rank FROM ranked")
def bm25_topk(spark, sf_dir):
    return keyword_index(spark, sf_dir).search(passages(spark, sf_dir), 10)


@query("bm25_path_filter", f"WITH {bm25_sql(10, keep="contains(path, 'src1')")} SELECT query_id, id, score, rank FROM ranked")
def bm25_path_filter(spark, sf_dir):
    return keyword_index(spark, sf_dir).search(passages(spark, sf_dir), 10, path_filter="src1")


@query("bm25_path_like", f"WITH {bm25_sql(10, keep="path ILIKE '%SRC_5%'")} SELECT query_id, id, score, rank FROM ranked")
def bm25_path_like(spark, sf_dir):
    return keyword_index(spark, sf_dir).search(passages(spark, sf_dir), 10, path_filter="SRC_5", like=True)


@query("bm25_duplicate_terms", f"WITH {bm25_sql(10, items="(SELECT item_id AS id, text || ' ' || text AS text FROM benchmark)")} SELECT query_id, id, score, rank FROM ranked")
def bm25_duplicate_terms(spark, sf_dir):
    twice = passages(spark, sf_dir).withColumn("text", F.concat_ws(" ", "text", "text"))
    return keyword_index(spark, sf_dir).search(twice, 10)


#: A quarter of the documents changed and a quarter gone: those of even ids lose their first 40 characters where the id is divisible by four, the others go.
_CHANGED_SQL = "(SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN substr(text, 41) ELSE text END AS text, source AS path FROM documents WHERE doc_id % 4 <> 2)"


def _changed_sql(sql: str) -> str:
    return sql.replace(DOCS_SQL, _CHANGED_SQL).replace("dl AS (SELECT d.doc_id AS id, d.source AS path, coalesce(n, 0) AS dl FROM documents d LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) t ON t.id = d.doc_id)", f"dl AS (SELECT d.id, d.path, coalesce(n, 0) AS dl FROM {_CHANGED_SQL} d LEFT JOIN (SELECT id, count(*) AS n FROM tok GROUP BY id) t ON t.id = d.id)")


def _changed_index(spark, sf_dir) -> KeywordIndex:
    """An index of its own that has been built over all documents and then changed by an upsert and a delete."""
    docs = documents(spark, sf_dir)
    made = KeywordIndex(session_store(spark), "changed")
    made.build(docs)
    made.upsert(docs.filter("id % 4 = 0").withColumn("text", F.expr("substr(text, 41)")))
    made.delete(docs.filter("id % 4 = 2").select("id"))
    return made


@query("bm25_after_changes", f"WITH {_changed_sql(bm25_sql(10))} SELECT query_id, id, score, rank FROM ranked")
def bm25_after_changes(spark, sf_dir):
    """Scores of a stored index after an upsert and a delete are those of the documents as they then are."""
    return _changed_index(spark, sf_dir).search(passages(spark, sf_dir), 10)


def _hundredths(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("knn_l2_topk", f"WITH {knn_sql(10)} SELECT * FROM near")
def knn_l2_topk(spark, sf_dir):
    return vector.nearest(table(spark, sf_dir, "embeddings"), _hundredths(spark, sf_dir), 10, id_="vec_id")


@query("knn_cosine_topk", f"WITH {knn_sql(10, 'cosine')} SELECT * FROM near")
def knn_cosine_topk(spark, sf_dir):
    return vector.nearest(table(spark, sf_dir, "embeddings"), _hundredths(spark, sf_dir), 10, id_="vec_id", metric="cosine")


@query("knn_filtered", f"WITH {knn_sql(10, keep='label = 3')} SELECT * FROM near")
def knn_filtered(spark, sf_dir):
    return vector.nearest(table(spark, sf_dir, "embeddings").filter("label = 3"), _hundredths(spark, sf_dir), 10, id_="vec_id")


def _vector_index(spark, sf_dir) -> VectorIndex:
    """Fitted on and built over half of the vectors, grown by an upsert of the others."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    made = VectorIndex(session_store(spark), "embeddings")
    made.build(rows.filter("id % 2 = 0"), cells=32)
    made.upsert(rows.filter("id % 2 = 1"))
    return made


@query("vector_index_topk", f"WITH {knn_sql(10)} SELECT * FROM near")
def vector_index_topk(spark, sf_dir):
    """The stored index with all of its cells probed misses nothing."""
    return _vector_index(spark, sf_dir).search(_hundredths(spark, sf_dir), 10, probes=32)


@query("vector_index_recall")
def vector_index_recall(spark, sf_dir):
    """One row (recall): of the ten nearest by a scan of all vectors, the share that half of the cells have."""
    found = _vector_index(spark, sf_dir).search(_hundredths(spark, sf_dir), 10, probes=16)
    return recall(found, knn_l2_topk(spark, sf_dir))


@query("vector_fallback_sort", f"WITH {knn_sql(10)} SELECT query_id, id, distance, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN distance = 0 THEN 'infinity'::DOUBLE ELSE distance END, rank)::INT AS position FROM near")
def vector_fallback_sort(spark, sf_dir):
    return fusion.by_distance(knn_l2_topk(spark, sf_dir))


_ITEM_VECTORS = "SELECT item_id AS query_id, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id"
_FUSE_SQL = """parts AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part, 0 AS list, rank FROM near UNION ALL SELECT query_id, id, 0.6::DOUBLE / (60 + rank), 1, rank FROM ranked),
summed AS (SELECT query_id, id, round(sum(part), 12) AS score, min(list * 1000000 + rank) AS seen FROM parts GROUP BY ALL),
fused AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, id)::INT AS rank FROM summed)"""


def _query_set(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return passages(spark, sf_dir).join(vectors, "query_id")


@query("rrf_fuse", f"WITH {knn_sql(20, queries=_ITEM_VECTORS)}, {bm25_sql(20)}, {_FUSE_SQL} SELECT * FROM fused")
def rrf_fuse(spark, sf_dir):
    asked = _query_set(spark, sf_dir)
    near = vector.nearest(table(spark, sf_dir, "embeddings"), asked, 20, id_="vec_id")
    return fusion.fuse(near, keyword_index(spark, sf_dir).search(passages(spark, sf_dir), 20))


def dedup_sql(hits: str, name: str) -> str:
    """CTEs lists_<name>, step_<name> and <name>(query_id, id, rank, kept_rank); hits has query_id, id, rank and lines."""
    return f"""lists_{name} AS (SELECT query_id, list({{'rank': rank, 'id': id, 'lines': lines}} ORDER BY rank) AS hits FROM {hits} GROUP BY query_id),
step_{name} AS (SELECT query_id, hits, 0 AS i, CAST([] AS STRUCT(rank INT, id BIGINT, lines VARCHAR[])[]) AS kept FROM lists_{name}
  UNION ALL SELECT query_id, hits, i + 1, CASE WHEN len(list_filter(kept, lambda k: len(list_intersect(k.lines, hits[i + 1].lines)) > 0.55 * len(list_distinct(list_concat(k.lines, hits[i + 1].lines))))) > 0 THEN kept ELSE list_append(kept, hits[i + 1]) END FROM step_{name} WHERE i < len(hits)),
{name} AS (SELECT query_id, k.id AS id, k.rank AS rank, place::INT AS kept_rank FROM (SELECT query_id, unnest(kept) AS k, unnest(range(1, len(kept) + 1)) AS place FROM step_{name} WHERE i = len(hits)))"""


def _keyword_hits(spark, sf_dir, n: int) -> DataFrame:
    """The passages' n best hits with their texts."""
    asked = passages(spark, sf_dir)
    hits = keyword_index(spark, sf_dir).search(asked, n)
    return search.with_texts(hits, documents(spark, sf_dir).select("id", "text"), asked.count() * n)


@query("greedy_dedup", f"WITH RECURSIVE {bm25_sql(30)}, hits AS (SELECT query_id, r.id, rank, list_distinct(string_split(text, chr(10))) AS lines FROM ranked r JOIN documents d ON d.doc_id = r.id), {dedup_sql('hits', 'kept')} SELECT * FROM kept")
def greedy_dedup(spark, sf_dir):
    return fusion.without_near_duplicates(_keyword_hits(spark, sf_dir, 30))


def _branch_sql(m: int) -> str:
    """One branch of escalating search: the m best of each list."""
    return f"""n{m} AS (SELECT * FROM near WHERE rank <= {m}), r{m} AS (SELECT * FROM ranked WHERE rank <= {m}),
{_FUSE_SQL.replace('parts', f'parts{m}').replace('summed', f'summed{m}').replace('fused', f'fused{m}').replace('FROM near', f'FROM n{m}').replace('FROM ranked', f'FROM r{m}')},
hits{m} AS (SELECT query_id, f.id, rank, list_distinct(string_split(text, chr(10))) AS lines FROM fused{m} f JOIN documents d ON d.doc_id = f.id),
{dedup_sql(f'hits{m}', f'kept{m}')}"""


@query(
    "hybrid_search",
    f"""WITH RECURSIVE {knn_sql(15, queries=_ITEM_VECTORS, keep='vec_id IN (SELECT doc_id FROM documents)')}, {bm25_sql(15).replace('ranked AS (SELECT * FROM (', 'ranked AS (SELECT * FROM (').replace('WHERE true', 'WHERE query_id IN (SELECT query_id FROM qs)')}, {_branch_sql(10)}, {_branch_sql(15)},
enough AS (SELECT query_id FROM kept10 GROUP BY 1 HAVING count(*) >= 5),
chosen AS (SELECT k.query_id, k.id, kept_rank, score FROM kept10 k JOIN fused10 f ON f.query_id = k.query_id AND f.id = k.id WHERE k.query_id IN (FROM enough)
  UNION ALL SELECT k.query_id, k.id, kept_rank, score FROM kept15 k JOIN fused15 f ON f.query_id = k.query_id AND f.id = k.id WHERE k.query_id NOT IN (FROM enough))
SELECT query_id, id, score, kept_rank AS rank FROM chosen WHERE kept_rank <= 5""",
)
def hybrid_search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = documents(spark, sf_dir)
    return search.search([docs.join(vectors, "id", "left")], _query_set(spark, sf_dir), 5, keywords=[keyword_index(spark, sf_dir)], texts=[docs]).drop("distance")


@query(
    "line_window_chunks",
    r"""WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''),
c AS (SELECT id, ls, unnest(range(CAST(1 + ceil(greatest(0, len(ls) - 20) / 15.0) AS BIGINT))) AS k FROM l)
SELECT id, k::INT AS chunk_index, (k * 15 + 1)::INT AS start_line, least(k * 15 + 20, len(ls))::INT AS end_line, array_to_string(list_slice(ls, k * 15 + 1, k * 15 + 20), chr(10)) AS chunk FROM c""",
)
def line_window_chunks(spark, sf_dir):
    return chunk.line_windows(documents(spark, sf_dir).select("id", "text"), lines=20, overlap=5).drop("text")


def _markdown(spark, sf_dir, heading: bool) -> DataFrame:
    """Pages as markdown: the title as H1 and each paragraph below an H2, or the paragraphs alone."""
    paragraphs = F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1))
    if not heading:
        return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.array_join(paragraphs, "\n\n\n").alias("text"))
    return _markdown_of(table(spark, sf_dir, "pages"), paragraphs)


def _markdown_of(pages: DataFrame, paragraphs: Column) -> DataFrame:
    sections = F.array_join(F.transform(paragraphs, lambda p, i: F.concat(F.lit("## part "), i.cast("string"), F.lit("\n\n"), p)), "\n\n")
    return pages.select(F.col("page_id").alias("id"), F.concat(F.lit("# "), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("\n\n"), sections).alias("text"))


_P_SQL = "SELECT page_id AS id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS ps FROM pages"


@query("heading_chunks", rf"SELECT id, 'part ' || i AS title, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS chunk_index, regexp_replace('## part ' || i || chr(10) || chr(10) || p, '\s+$', '') AS chunk FROM (SELECT id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM ({_P_SQL})) WHERE regexp_replace(p, '\s', '', 'g') <> ''")
def heading_chunks(spark, sf_dir):
    return chunk.document_chunks(_markdown(spark, sf_dir, True)).drop("text")


@query("paragraph_chunks", rf"SELECT id, 'untitled' AS title, (row_number() OVER (PARTITION BY id ORDER BY i) - 1)::INT AS chunk_index, regexp_replace(p, '^\s+|\s+$', '', 'g') AS chunk FROM (SELECT id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM ({_P_SQL})) WHERE regexp_replace(p, '\s', '', 'g') <> ''")
def paragraph_chunks(spark, sf_dir):
    return chunk.document_chunks(_markdown(spark, sf_dir, False)).drop("text")


@query("chunk_ids", "SELECT doc_id, 'docs:' || source || '/' || lang || '/' || doc_id || '.txt:0' AS id FROM documents")
def chunk_ids(spark, sf_dir):
    path = F.concat(F.concat_ws("/", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", text.chunk_id(F.lit("docs"), F.col("source"), path, F.lit(0)).alias("id"))


@query("slugify", r"""SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE left(s, 100) END AS slug FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(lower(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slugify(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query("freshness_tag", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'v:unknown' WHEN lang = 'en' THEN 'v:' || left(sha256(text), 8) ELSE 'v:' || source END AS tag FROM documents")
def freshness_tag(spark, sf_dir):
    version = F.when(F.col("lang") == "en", F.substring(F.sha2("text", 256), 1, 40)).when(F.col("lang") != "de", F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", text.freshness_tag(version).alias("tag"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


def _files(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"), "lang")


@query(
    "manifest_diff",
    """WITH f AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h, lang FROM documents), m AS (SELECT path, CASE WHEN lang = 'fr' THEN 'old' ELSE h END AS h FROM f WHERE lang <> 'de' UNION ALL SELECT path || '.gone', h FROM f WHERE lang = 'es')
SELECT coalesce(f.path, m.path) AS path, CASE WHEN m.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'deleted' WHEN f.h <> m.h THEN 'changed' ELSE 'same' END AS state FROM f FULL JOIN m ON f.path = m.path""",
)
def manifest_diff(spark, sf_dir):
    files = _files(spark, sf_dir)
    before = files.filter("lang <> 'de'").select("path", F.when(F.col("lang") == "fr", "old").otherwise(F.col("sha256")).alias("sha256"))
    gone = files.filter("lang = 'es'").select(F.concat("path", F.lit(".gone")).alias("path"), "sha256")
    return index.manifest_diff(files, before.union(gone))


@query("embed_cache_split", "SELECT DISTINCT 'm' AS model, sha256(text) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def embed_cache_split(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.lit("m").alias("model"), text.content_hash(F.col("text")).alias("content_hash"), "lang")
    return index.cache_split(chunks.drop("lang"), chunks.filter("lang = 'en'").drop("lang").distinct().withColumn("embedding", F.array(F.lit(0.0))))[1]


@query("stale_chunks", "SELECT source || ':' || doc_id || ':1' AS id, source AS file_path FROM documents WHERE lang = 'en'")
def stale_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = lambda k: F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.lit(k)).alias("id")
    stored = docs.select(name("0"), F.col("source").alias("file_path")).union(docs.filter("lang = 'en'").select(name("1"), "source"))
    return index.stale_chunks(stored, docs.select(name("0")), docs.select(F.col("source").alias("file_path")).distinct()).select("id", "file_path")


@query("index_sync_diff", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def index_sync_diff(spark, sf_dir):
    return index.only_left(documents(spark, sf_dir).select("id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


_HOST = "^https?://([^/?#]+)"
_PATH = "^https?://[^/?#]+/([^?#]*)"


def _pages(spark, sf_dir) -> DataFrame:
    host = F.regexp_extract("url", _HOST, 1)
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), host.alias("host"), F.concat_ws("/", host, F.regexp_extract("url", _PATH, 1)).alias("file_path"))


def _roots(spark, sf_dir) -> DataFrame:
    """Hosts as folders named by their first label; those of .org aren't mounted."""
    hosts = _pages(spark, sf_dir).select("host").distinct()
    return hosts.select(F.substring_index("host", ".", 1).alias("name"), F.col("host").alias("path"), (~F.col("host").endswith(".org")).alias("exists"))


_ROOTS_SQL = f"roots AS (SELECT DISTINCT split_part(h, '.', 1) AS name, h AS path, NOT ends_with(h, '.org') AS there FROM (SELECT regexp_extract(url, '{_HOST}', 1) AS h FROM pages)), safe AS (SELECT name, min(path) AS path FROM roots WHERE there GROUP BY name HAVING count(*) = 1)"


@query("safe_root_map", f"WITH {_ROOTS_SQL} SELECT name, path FROM safe")
def safe_root_map(spark, sf_dir):
    return index.safe_roots(_roots(spark, sf_dir)).select("name", "path")


@query("deleted_source_sweep", f"WITH {_ROOTS_SQL}, p AS (SELECT page_id AS id, split_part(regexp_extract(url, '{_HOST}', 1), '.', 1) || '/' || regexp_extract(url, '{_PATH}', 1) AS file_path, url FROM pages) SELECT id, file_path FROM p WHERE split_part(file_path, '/', 1) IN (SELECT name FROM safe) AND file_path NOT IN (SELECT file_path FROM p WHERE NOT contains(url, '?'))")
def deleted_source_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat_ws("/", F.substring_index(F.regexp_extract("url", _HOST, 1), ".", 1), F.regexp_extract("url", _PATH, 1)).alias("file_path"), "url")
    return index.deleted_sources(rows.drop("url"), _roots(spark, sf_dir), rows.filter(~F.col("url").contains("?")).select("file_path").distinct())


@query("excluded_prefix_sweep", f"SELECT id, file_path FROM (SELECT page_id AS id, 'web/' || regexp_extract(url, '{_PATH}', 1) AS file_path FROM pages) WHERE starts_with(file_path, 'web/fr/') OR starts_with(file_path, 'web/de/')")
def excluded_prefix_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat(F.lit("web/"), F.regexp_extract("url", _PATH, 1)).alias("file_path"))
    return rows.filter(index.under(F.col("file_path"), "web", ["fr", "de"]))


@query("manifest_routing", "SELECT path, sha256, CASE WHEN starts_with(path, 'src1') THEN 'a' WHEN starts_with(path, 'src2') THEN 'b' ELSE '_orphaned' END AS project FROM (SELECT source || '/' || doc_id AS path, sha256(text) AS sha256 FROM documents)")
def manifest_routing(spark, sf_dir):
    roots = spark.createDataFrame([("a", "src1", 0), ("b", "src2", 1), ("b", "src12", 2)], "project string, root string, place int")
    return index.route_manifest(_files(spark, sf_dir).select("path", "sha256"), roots)


@query(
    "batch_packing_whole",
    f"""WITH RECURSIVE d AS (SELECT source, doc_id, length(left(text, {2 * index.BATCH_TOKENS})) // 2 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
s AS (SELECT source, doc_id, tokens, rn, 0::BIGINT AS batch, tokens AS used, 1 AS items FROM d WHERE rn = 1
 UNION ALL SELECT d.source, d.doc_id, d.tokens, d.rn, CASE WHEN s.used + d.tokens > {index.BATCH_TOKENS} OR s.items >= {index.BATCH_ITEMS} THEN s.batch + 1 ELSE s.batch END, CASE WHEN s.used + d.tokens > {index.BATCH_TOKENS} OR s.items >= {index.BATCH_ITEMS} THEN d.tokens ELSE s.used + d.tokens END, CASE WHEN s.used + d.tokens > {index.BATCH_TOKENS} OR s.items >= {index.BATCH_ITEMS} THEN 1 ELSE s.items + 1 END FROM s JOIN d ON d.source = s.source AND d.rn = s.rn + 1)
SELECT source, doc_id, tokens::BIGINT AS tokens, batch FROM s""",
)
def batch_packing_whole(spark, sf_dir):
    """The operator's own limits, at which no text of up to 160,000 characters is cut."""
    return index.packed(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), "source", ["doc_id"], keep_text=False)


@query(
    "token_ema",
    """WITH RECURSIVE b AS (SELECT source, n_chars AS chars, n_chars // 3 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
s AS (SELECT source, rn, CASE WHEN tokens > 0 THEN chars::DOUBLE / tokens END AS ratio FROM b WHERE rn = 1
 UNION ALL SELECT b.source, b.rn, CASE WHEN b.tokens <= 0 THEN s.ratio WHEN s.ratio IS NULL THEN b.chars::DOUBLE / b.tokens ELSE 0.8 * s.ratio + 0.2 * b.chars / b.tokens END FROM s JOIN b ON b.source = s.source AND b.rn = s.rn + 1)
SELECT source, round(arg_max(ratio, rn), 6) AS ratio FROM s GROUP BY source""",
)
def token_ema(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.col("n_chars").alias("chars"), F.floor(F.col("n_chars") / 3).alias("tokens"))
    return index.calibrated(rows, "source", "doc_id").withColumn("ratio", F.round("ratio", 6))


def _order_facts(spark, sf_dir) -> DataFrame:
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.concat_ws("|", F.col("o_custkey").cast("string"), F.lit("status")).alias("chain_key"), F.col("o_orderstatus").alias("object"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("valid_from"))
    return facts.apply_facts(made, ["valid_from", "fact_id"])


_FACTS_SQL = """f AS (SELECT o_orderkey AS fact_id, o_custkey || '|status' AS chain_key, o_orderstatus AS object, epoch_ms(o_orderdate) AS valid_from FROM orders),
a AS (SELECT *, CASE WHEN p IS NULL THEN 'INSERT' WHEN p = object THEN 'NOOP' ELSE 'SUPERSEDE' END AS action FROM (SELECT *, lag(object) OVER (PARTITION BY chain_key ORDER BY valid_from, fact_id) AS p FROM f)),
v AS (SELECT fact_id, chain_key, object, valid_from, action, sum(CASE WHEN action = 'NOOP' THEN 0 ELSE 1 END) OVER (PARTITION BY chain_key ORDER BY valid_from, fact_id)::INT AS version FROM a),
live AS (SELECT *, lead(valid_from) OVER (PARTITION BY chain_key ORDER BY valid_from, fact_id) AS ends FROM v WHERE action <> 'NOOP'),
rows_ AS (SELECT fact_id, chain_key, object, valid_from, version, coalesce(ends, 0)::BIGINT AS invalid_at, ends IS NULL AS is_current FROM live)"""


@query("fact_state_machine", f"WITH {_FACTS_SQL} SELECT v.fact_id, v.chain_key, v.object, v.valid_from, v.action, v.version, invalid_at, coalesce(is_current, false) AS is_current FROM v LEFT JOIN rows_ USING (fact_id)")
def fact_state_machine(spark, sf_dir):
    return _order_facts(spark, sf_dir)


@query("fact_current", f"WITH {_FACTS_SQL} SELECT fact_id, chain_key, object, version FROM rows_ WHERE is_current")
def fact_current(spark, sf_dir):
    return facts.current_facts(_order_facts(spark, sf_dir)).select("fact_id", "chain_key", "object", "version")


@query("fact_as_of", f"WITH {_FACTS_SQL} SELECT fact_id, chain_key, object FROM rows_ WHERE valid_from <= 820454400000 AND (invalid_at = 0 OR invalid_at > 820454400000)")
def fact_as_of(spark, sf_dir):
    held = _order_facts(spark, sf_dir).filter("action <> 'NOOP'")
    return facts.as_of(held, F.lit(820454400000)).select("fact_id", "chain_key", "object")


@query("fact_repair", f"WITH {_FACTS_SQL} SELECT fact_id, version, CASE WHEN r = 1 THEN 0 ELSE 99 END::BIGINT AS invalid_at, r = 1 AS is_current FROM (SELECT *, row_number() OVER (PARTITION BY chain_key ORDER BY version DESC, fact_id) AS r FROM rows_)")
def fact_repair(spark, sf_dir):
    broken = _order_facts(spark, sf_dir).filter("action <> 'NOOP'").withColumns({"is_current": F.lit(True), "invalid_at": F.lit(0).cast("long")})
    return facts.repaired(broken, F.lit(99).cast("long")).select("fact_id", "version", "invalid_at", "is_current")


@query("drift_exact", f"WITH {_FACTS_SQL} SELECT c_custkey AS subject, 'F' AS object, object AS fact_object, 'exact' AS match_type FROM customer JOIN rows_ ON chain_key = c_custkey || '|status' AND is_current WHERE object <> 'F'")
def drift_exact(spark, sf_dir):
    claims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subject"), F.lit("status").alias("predicate"), F.lit("F").alias("object"))
    return drift.exact_drift(claims.withColumn("subject", F.col("subject")), fact_current(spark, sf_dir)).select("subject", "object", "fact_object", "match_type")


@query("drift_semantic_whole", f"WITH {knn_sql(1, 'cosine', 'SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 100 = 0', 'vec_id % 100 <> 0')} SELECT query_id AS claim_id, id AS chain_key, round(1 - distance, 4) AS similarity FROM near WHERE 1 - distance >= {drift.SIMILAR}")
def drift_semantic_whole(spark, sf_dir):
    """Facts of all labels at the operator's own threshold: every vector is either a claim or a fact."""
    v = table(spark, sf_dir, "embeddings")
    known = v.filter("vec_id % 100 <> 0").select(F.col("vec_id").alias("chain_key"), "embedding")
    claims = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("claim_id"), F.col("vec_id").alias("chain_key"), "embedding")
    return drift.semantic_candidates(claims, known)


@query("user_messages", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def user_messages(spark, sf_dir):
    return drift.user_messages(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")


def _scored(spark, sf_dir) -> DataFrame:
    cases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.when(F.length("text") >= 220, "long").otherwise("short").alias("query_class"), F.array(F.substring("text", 1, 40)).alias("expected"))
    hits = _keyword_hits(spark, sf_dir, 10).select(F.col("query_id").alias("case_id"), F.col("text").alias("source"), "rank")
    return evals.score_cases(cases, hits)


_EVAL_SQL = f"""{bm25_sql(10)}, first_hit AS (SELECT query_id, min(rank) AS r FROM ranked JOIN documents d ON d.doc_id = ranked.id JOIN benchmark b ON b.item_id = query_id WHERE contains(d.text, left(b.text, 40)) GROUP BY query_id),
cases AS (SELECT item_id AS case_id, CASE WHEN length(text) >= 220 THEN 'long' ELSE 'short' END AS query_class, coalesce(r <= 5, false)::INT::DOUBLE AS recall5, coalesce(r <= 10, false)::INT::DOUBLE AS recall10, coalesce(CASE WHEN r <= 10 THEN 1 / log2(r + 1) END, 0) AS ndcg10, coalesce(1.0::DOUBLE / r, 0) AS mrr FROM benchmark LEFT JOIN first_hit ON query_id = item_id)"""


@query("eval_cases", f"WITH {_EVAL_SQL} SELECT case_id, query_class, recall5, recall10, round(ndcg10, 9) AS ndcg10, round(mrr, 9) AS mrr FROM cases")
def eval_cases(spark, sf_dir):
    return _scored(spark, sf_dir).withColumns({"ndcg10": F.round("ndcg10", 9), "mrr": F.round("mrr", 9)})


@query(
    "eval_arms",
    f"""WITH {_EVAL_SQL}, l AS (SELECT query_class, metric, a, b FROM (SELECT query_class, unnest(['recall5', 'recall10', 'ndcg10', 'mrr']) AS metric, unnest([recall5, recall10, ndcg10, mrr]) AS a, unnest([recall5, recall10, ndcg10, mrr]) / 2 AS b FROM cases))
SELECT metric, query_class, round(avg(a), 9) AS mean_a, round(avg(b), 9) AS mean_b, round(avg(b - a), 9) AS delta, count(*)::BIGINT AS n FROM l GROUP BY GROUPING SETS ((metric), (metric, query_class))""",
)
def eval_arms(spark, sf_dir):
    a = _scored(spark, sf_dir)
    b = a.select("case_id", "query_class", *[(F.col(m) / 2).alias(m) for m in evals.METRICS])
    return evals.compare_arms(a, b).withColumns({c: F.round(c, 9) for c in ("mean_a", "mean_b", "delta")})


@query("bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return evals.bootstrap(_scored(spark, sf_dir), "query_class", "case_id", "mrr")


@query("stale_rate", "SELECT source, count(*) FILTER (lang = 'en')::BIGINT AS fresh, count(*) FILTER (lang IN ('fr', 'es'))::BIGINT AS stale, count(*) FILTER (lang = 'de')::BIGINT AS unknown, round(count(*) FILTER (lang IN ('fr', 'es')) / nullif(count(*) FILTER (lang <> 'de'), 0), 9) AS rate FROM documents GROUP BY source")
def stale_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.when(F.col("lang") != "de", F.sha2("text", 256)).alias("version_id"), F.when(F.col("lang") == "en", F.sha2("text", 256)).otherwise("newer").alias("current_version"))
    return evals.stale_stats(rows, ["source"]).withColumn("rate", F.round("rate", 9))


_CALLS_SQL = "calls AS (SELECT event_id AS call_id, event_type || '-v' || user_id AS model, (user_id * 1000)::BIGINT AS input_tokens, event_id AS output_tokens, ts FROM events)"


def _calls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), F.concat("event_type", F.lit("-v"), F.col("user_id").cast("string")).alias("model"), (F.col("user_id") * 1000).alias("input_tokens"), F.col("event_id").alias("output_tokens"), "ts")


_PRICES = [("view", 1.0, 2.0), ("view-v1", 3.0, 4.0), ("signup", 5.0, 25.0), ("click-v", 0.5, 0.25)]


@query("priced_calls", f"WITH {_CALLS_SQL}, p(prefix, i, o) AS (VALUES {', '.join(map(str, _PRICES))}) SELECT call_id, model, input_tokens, output_tokens, round(coalesce(input_tokens / 1e6 * i + output_tokens / 1e6 * o, 0)::DOUBLE, 9) AS usd FROM (SELECT call_id, model, input_tokens, output_tokens, arg_max(i, length(prefix)) AS i, arg_max(o, length(prefix)) AS o FROM calls LEFT JOIN p ON starts_with(model, prefix) GROUP BY call_id, model, input_tokens, output_tokens)")
def priced_calls(spark, sf_dir):
    prices = spark.createDataFrame(_PRICES, "prefix string, usd_in double, usd_out double")
    # equal rows of one call are one call, as the SQL has it
    calls = _calls(spark, sf_dir).drop("ts").distinct()
    return metering.priced(calls, prices).withColumn("usd", F.round("usd", 9))


@query("calls_per_day", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*)::BIGINT AS calls FROM events GROUP BY 1")
def calls_per_day(spark, sf_dir):
    return metering.calls_per_day(_calls(spark, sf_dir))


@query("cost_report", f"WITH {_CALLS_SQL} SELECT count(*)::BIGINT AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(input_tokens / 1e6 * 2 + output_tokens / 1e6 * 3)::DOUBLE, 4) AS usd FROM calls")
def cost_report(spark, sf_dir):
    return metering.estimate(metering.priced(_calls(spark, sf_dir), spark.createDataFrame([("", 2.0, 3.0)], "prefix string, usd_in double, usd_out double")))


@query("status_counts", "SELECT source AS project, lang AS kind, count(*)::BIGINT AS n FROM documents GROUP BY ROLLUP (source, lang)")
def status_counts(spark, sf_dir):
    return index.status(table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("lang").alias("kind")))


@query("top_paths", f"SELECT folder, count(*)::BIGINT AS n FROM (SELECT regexp_extract(p, '^[^/]*/[^/]*') AS folder FROM (SELECT regexp_extract(url, '{_HOST}', 1) || '/' || regexp_extract(url, '{_PATH}', 1) AS p FROM pages)) GROUP BY folder ORDER BY n DESC, folder LIMIT 15")
def top_paths(spark, sf_dir):
    return index.top_paths(_pages(spark, sf_dir).select(F.col("file_path").alias("path")))


@query("complete_files", "SELECT source AS file_path FROM documents GROUP BY source HAVING count(*) = count(*) FILTER (n_chars < 15000)")
def complete_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file_path"), F.col("doc_id").alias("id"), "n_chars")
    return index.complete_files(docs.groupBy("file_path").agg(F.count("*").alias("n")), docs.filter("n_chars < 15000"))


@query("remodel_decision", "SELECT DISTINCT source, lang, CASE WHEN lang = 'en' AND source = 'src1' THEN 'backfill' WHEN lang IN ('en', 'fr') AND source <> 'src1' THEN 'keep' WHEN source IN ('src3', 'src4') THEN 'blocked' WHEN source = 'src1' OR lang NOT IN ('en', 'fr') THEN 'clear' END AS decision FROM documents")
def remodel_decision(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "lang").distinct()
    kind = F.when(F.col("lang") == "en", "code").otherwise("docs")
    recorded = F.when(F.col("source") != "src1", F.when(F.col("lang").isin("en", "fr"), "new").otherwise("old"))
    return rows.withColumn("decision", index.remodel_decision(kind, recorded, F.lit("new"), ~F.col("source").isin("src3", "src4")))


@query("result_overlap", f"WITH {bm25_sql(10)}, {knn_sql(10, queries=_ITEM_VECTORS)}, a AS (SELECT query_id, list(id) AS x FROM ranked GROUP BY 1), b AS (SELECT query_id, list(id) AS y FROM near GROUP BY 1) SELECT query_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) AS overlap FROM a JOIN b USING (query_id)")
def result_overlap(spark, sf_dir):
    a = bm25_topk(spark, sf_dir).groupBy("query_id").agg(F.collect_list("id").alias("x"))
    near = vector.nearest(table(spark, sf_dir, "embeddings"), _query_set(spark, sf_dir), 10, id_="vec_id")
    b = near.groupBy("query_id").agg(F.collect_list("id").alias("y"))
    return a.join(b, "query_id").select("query_id", F.round(evals.list_overlap(F.col("x"), F.col("y")), 9).alias("overlap"))
