"""Where documents say something else than the facts that hold."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import canonical_key, chain_key, fact_text
from larkspur.operators import vector

SIMILAR = 0.85
TRIPLE = "subject string, predicate string, object string"


def user_messages(messages: DataFrame) -> DataFrame:
    """Messages from which facts may be taken."""
    return messages.filter(F.col("role") == "user")


def with_cache(rows: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with what the cache has for them, and the distinct keys that it lacks."""
    return rows.join(cache, keys, "left"), rows.select(*keys).distinct().join(cache, keys, "left_anti")


def extract_facts(texts: DataFrame, extractor: Callable[[], Callable[[str], list[tuple[str, str, str]]]], text: str = "text") -> DataFrame:
    """(source columns, subject, predicate, object) of each fact that extractor()(text) finds; each different text is read once.

    extractor makes a callable on the executor, which may hold a client. An error there fails the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = extractor()
        for frame in frames:
            yield pd.DataFrame([(h, *t) for h, x in zip(frame["hash"], frame["text"], strict=True) for t in find(x)], columns=["hash", "subject", "predicate", "object"])

    hashed = texts.filter(F.col(text).isNotNull()).withColumn("hash", F.sha2(F.col(text), 256))
    once = hashed.groupBy("hash").agg(F.first(text).alias("text"))
    return hashed.drop(text).join(once.mapInPandas(run, f"hash string, {TRIPLE}"), "hash").drop("hash")


def _settled(new: DataFrame) -> DataFrame:
    """new in the checkpoint folder, so that no lost executor has anything asked again."""
    from larkspur.sources.shared import shared_dir

    shared_dir(new.sparkSession)
    return new.checkpoint()


def _tokens(*texts: str) -> int:
    """An estimate where a model doesn't tell: four characters a token."""
    return sum(map(len, texts)) // 4


Grant = Callable[[DataFrame], DataFrame]


def extract_cached(texts: DataFrame, cache: DataFrame, extractor: Callable[[], Callable[[str], list[tuple[str, str, str]]]], model: str = "", version: str = "1", grant: Grant | None = None, keep: Grant = _settled) -> tuple[DataFrame, DataFrame]:
    """Facts of texts (file_path, text, ...) as extract_facts gives them, and the new rows (text_sha, model, prompt_version, triples, input_tokens, output_tokens).

    Each different text is read once, and not at all where the cache has it for that model and prompt; that a text has no
    facts is kept too. The join with the texts gives each file its facts whether they were cached or not. grant takes the
    keys (call_key) that would be asked and gives those that may be; keep stores the new rows and gives them as stored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = extractor()
        for frame in frames:
            found = [[dict(zip(("subject", "predicate", "object"), t, strict=True)) for t in find(x)] for x in frame["text"]]
            yield pd.DataFrame({"text_sha": frame["text_sha"], "triples": found, "input_tokens": [_tokens(x) for x in frame["text"]], "output_tokens": [_tokens(*(v for t in f for v in t.values())) for f in found]}, columns=["text_sha", "triples", "input_tokens", "output_tokens"])

    hashed = texts.filter("text IS NOT NULL").withColumn("text_sha", F.sha2("text", 256))
    own = cache.filter((F.col("model") == model) & (F.col("prompt_version") == version)).select("text_sha", "triples")
    missing = hashed.groupBy("text_sha").agg(F.first("text").alias("text")).join(own, "text_sha", "left_anti")
    if grant is not None:
        missing = missing.join(grant(missing.select(F.col("text_sha").alias("call_key"))).withColumnRenamed("call_key", "text_sha"), "text_sha", "left_semi")
    triples = f"array<struct<{TRIPLE.replace(' string', ':string')}>>"
    new = missing.mapInPandas(run, f"text_sha string, triples {triples}, input_tokens long, output_tokens long")
    new = keep(new.select("text_sha", F.lit(model).alias("model"), F.lit(version).alias("prompt_version"), "triples", "input_tokens", "output_tokens"))
    known = own.unionByName(new.select("text_sha", "triples"))
    facts = hashed.drop("text").join(known, "text_sha").select(*[c for c in hashed.columns if c != "text"], F.explode("triples").alias("t")).select("*", "t.*").drop("t", "text_sha")
    return facts, new


def exact_drift(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Claims whose chain has a current fact with another object. Equal claims of two chunks are two rows."""
    c = claims.withColumn("chain_key", chain_key(F.col("subject"), F.col("predicate")))
    f = facts.select("chain_key", F.col("object").alias("fact_object"))
    return c.join(f, "chain_key").filter(F.col("object") != F.col("fact_object")).withColumn("match_type", F.lit("exact"))


def semantic_candidates(claims: DataFrame, facts: DataFrame, least: float = SIMILAR, claim: str = "claim_id") -> DataFrame:
    """(claim, chain_key, similarity): of claims whose chain has no fact, the nearest fact by cosine, if similar enough.

    claims: claim, chain_key, embedding; facts: chain_key, embedding. Ties by chain_key. Rounded after the threshold. Both
    sides stay on executors, and the threshold rules out cells of facts before they are met.
    """
    missed = claims.join(facts.select("chain_key"), "chain_key", "left_anti")
    best = vector.nearest_join(facts, missed, 1, id_="chain_key", query=claim, metric="cosine", within=1 - least)
    return best.withColumn("similarity", 1 - F.col("distance")).filter(F.col("similarity") >= least).select(F.col("query_id").alias(claim), F.col("id").alias("chain_key"), F.round("similarity", 4).alias("similarity"))


def judged(candidates: DataFrame, cache: DataFrame, judge: Callable[[], Callable[[str, str], str]], remaining: int, model: str = "", grant: Grant | None = None, keep: Grant = _settled) -> tuple[DataFrame, DataFrame]:
    """Candidates (claim_key, fact_key, ...) with verdict, confidence and error, and the new rows (judge_key, reply, input_tokens, output_tokens).

    Pairs in the cache cost nothing; of the others those that grant allows are judged, or without it the first `remaining` in
    order of their keys; the rest have cap_hit. A reply that is no verdict is an error of that row. keep stores the new rows,
    and what follows reads them as stored.
    """
    from larkspur.functions.text import verdict

    keyed = candidates.withColumn("judge_key", F.sha2(F.concat_ws("\n", "claim_key", "fact_key", F.lit(model)), 256))
    hit, missed = with_cache(keyed, cache.select("judge_key", "reply"), ["judge_key"])
    asked = keyed.select("judge_key", "claim_key", "fact_key").join(missed, "judge_key", "left_semi").dropDuplicates(["judge_key"])
    if grant is not None:
        asked = asked.join(grant(asked.select(F.col("judge_key").alias("call_key"))).withColumnRenamed("call_key", "judge_key"), "judge_key", "left_semi")
    elif missed.count() > remaining:
        asked = asked.orderBy("judge_key").limit(remaining)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = judge()
        for frame in frames:
            replies = [ask(a, b) for a, b in zip(frame["claim_key"], frame["fact_key"], strict=True)]
            used = [_tokens(a, b) for a, b in zip(frame["claim_key"], frame["fact_key"], strict=True)]
            yield pd.DataFrame({"judge_key": frame["judge_key"], "reply": replies, "input_tokens": used, "output_tokens": [_tokens(r) for r in replies]}, columns=["judge_key", "reply", "input_tokens", "output_tokens"])

    new = keep(asked.mapInPandas(run, "judge_key string, reply string, input_tokens long, output_tokens long"))
    all_replies = hit.join(new.select("judge_key", F.col("reply").alias("new_reply")), "judge_key", "left").withColumn("reply", F.coalesce("reply", "new_reply")).drop("new_reply")
    out = all_replies.withColumn("verdict", verdict(F.col("reply")))
    return out.withColumns({"error": F.col("reply").isNotNull() & F.col("verdict").isNull(), "cap_hit": F.col("reply").isNull()}), new


def claim_keys(claims: DataFrame) -> DataFrame:
    return claims.withColumns({"claim_key": canonical_key(F.col("subject"), F.col("predicate"), F.col("object")), "fact_text": fact_text(F.col("subject"), F.col("predicate"), F.col("object"))})


REPORT = "subject string, predicate string, match_type string, similarity double, confidence double, doc_object string, source string, fact_subject string, fact_predicate string, fact_object string, session_id string, version int"


class Drift(NamedTuple):
    """What a scan found: drift has REPORT's columns, counters one row (facts_scanned, docs_scanned, judge_calls, judge_errors,
    cap_hit), replies the new rows of the judge's cache."""

    drift: DataFrame
    counters: DataFrame
    replies: DataFrame


def scan(claims: DataFrame, facts: DataFrame, docs: DataFrame, cache: DataFrame, judge: Callable[[], Callable[[str, str], str]], remaining: int, least: float = SIMILAR, model: str = "", grant: Grant | None = None, keep: Grant = _settled) -> Drift:
    """Claims of documents that contradict current facts.

    claims: subject, predicate, object, source, embedding. facts, one for each chain: subject, predicate, object, session_id,
    version, embedding. docs: the scanned chunks. A claim whose chain has a fact is compared with that fact alone; any other
    goes to the judge with the nearest fact, if that is similar enough. Replies in the cache (judge_key, reply) cost nothing,
    `remaining` others are asked for, or those that grant allows (see judged); a reply that is no verdict is counted and left out.
    """
    known = facts.withColumn("chain_key", chain_key(F.col("subject"), F.col("predicate")))
    told = claim_keys(claims).withColumn("chain_key", chain_key(F.col("subject"), F.col("predicate"))).withColumnRenamed("object", "doc_object")
    fact = known.select("chain_key", *[F.col(c).alias(f"fact_{c}") for c in ("subject", "predicate", "object")], "session_id", "version")
    exact = told.join(fact, "chain_key").filter(F.col("doc_object") != F.col("fact_object"))
    exact = exact.withColumns({"match_type": F.lit("exact"), "similarity": F.lit(None).cast("double"), "confidence": F.lit(None).cast("double")})
    names = [c.split()[0] for c in REPORT.split(", ")]
    near = semantic_candidates(told.dropDuplicates(["claim_key"]), known, least, "claim_key")
    fact_key = canonical_key(F.col("fact_subject"), F.col("fact_predicate"), F.col("fact_object"))
    pairs = near.join(fact, "chain_key").withColumn("fact_key", fact_key)
    answers, replies = judged(pairs, cache, judge, remaining, model, grant, keep)
    yes = answers.filter("verdict.contradicts").withColumn("confidence", F.col("verdict.confidence")).drop("chain_key")
    semantic = told.select("claim_key", "subject", "predicate", "doc_object", "source").join(yes, "claim_key").withColumn("match_type", F.lit("semantic"))
    # equal claims of several chunks are rows of their own
    found = exact.select(*names).unionByName(semantic.select(*names))
    asked = replies.agg(F.count("*").alias("judge_calls"))
    errors = answers.join(replies.select("judge_key"), "judge_key", "left_semi").select("judge_key", "error").distinct()
    counters = facts.agg(F.count("*").alias("facts_scanned")).crossJoin(docs.agg(F.count("*").alias("docs_scanned"))).crossJoin(asked)
    counters = counters.crossJoin(errors.agg(F.count_if("error").alias("judge_errors"))).crossJoin(answers.agg(F.coalesce(F.bool_or("cap_hit"), F.lit(False)).alias("cap_hit")))
    return Drift(found, counters, replies)


def preflight(project: str, known: dict[str, bool], extractor: object, judge: object) -> str | None:
    """Why a scan can't begin: "no_model" without extractor or judge, "project_unknown", "not_enabled"; else None."""
    if extractor is None or judge is None:
        return "no_model"
    if project not in known:
        return "project_unknown"
    return None if known[project] else "not_enabled"


#: What the command ends with: drift found or not, or why it couldn't begin.
EXIT = {None: 0, "drift": 1, "project_unknown": 2, "not_enabled": 2, "no_model": 3}


def report(drift: DataFrame, n: int = 50) -> DataFrame:
    """The first rows to print, by subject, predicate and kind of match."""
    return drift.orderBy("subject", "predicate", "match_type").limit(n)


def kinds(drift: DataFrame) -> DataFrame:
    """Rows by kind of match."""
    w = Window.partitionBy("match_type")
    return drift.select("match_type", F.count("*").over(w).alias("n")).distinct()
