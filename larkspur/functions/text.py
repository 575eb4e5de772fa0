"""Column functions over text: tokens, hashes, slugs, tags."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of an identifier: an acronym before a capitalised word, a word, capitals, digits. A fixed value.
SUBWORD = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
#: White space as Python's strip() takes it off; Spark's trim takes spaces alone.
_BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0  -     　]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def _cut(text: Column, whole: Callable[[Column], Column]) -> Column:
    """Unicode words, each split into its ASCII parts in lower case; a word without any becomes whole(word), an array."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    parts = lambda w: F.regexp_extract_all(w, F.lit(SUBWORD), F.lit(0))
    # parts are of ASCII letters and digits alone, so that lower() may come after
    cut = F.flatten(F.transform(words, lambda w: F.when(w.rlike("[A-Za-z0-9]"), F.transform(parts(w), F.lower)).otherwise(whole(w))))
    return F.coalesce(cut, F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Unicode words, each split into its ASCII parts and lower-cased; a word without any stays whole, in lower case."""
    return _cut(text, lambda w: F.array(F.lower(w)))


def _folding() -> tuple[str, str]:
    """Letters of U+00C0 to U+1FFF that are another letter with accents, and that letter."""
    whole = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in whole if len(d) > 1 and all(map(unicodedata.combining, d[1:])) and d[0].isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def terms(text: Column) -> Column:
    """tokens as an index keeps them: without accents, and without those of underscores alone. Parts of words have neither."""
    fold = lambda w: F.translate(F.lower(w), *_folding())
    return _cut(text, lambda w: F.when(w.rlike("^_+$"), F.array().cast("array<string>")).otherwise(F.array(fold(w))))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def slugify(title: Column, longest: int = 100) -> Column:
    """Cut after hyphens are trimmed, so that a cut slug may end in one."""
    low = F.regexp_replace(strip(F.lower(title)), r"(?U)[^\w\s-]", "")
    slug = F.substring(F.regexp_replace(F.regexp_replace(low, r"(?U)[\s_]+", "-"), "^-+|-+$", ""), 1, longest)
    return F.when(slug == "", "untitled").otherwise(slug)


def freshness_tag(version: Column) -> Column:
    known = F.when(version.rlike("^[0-9a-fA-F]{40}$"), F.substring(version, 1, 8)).otherwise(version)
    return F.concat(F.lit("v:"), F.when(version.isNull() | (version == ""), "unknown").otherwise(known))


def chunk_id(kind: Column, root: Column, path: Column, index: Column) -> Column:
    return F.concat_ws(":", kind, F.concat_ws("/", root, path), index.cast("string"))


def strip_fence(reply: Column) -> Column:
    """A model's reply without the code fence around it and its language tag."""
    inner = F.regexp_extract(strip(reply), r"(?s)^```(?:json)?(.*?)(?:```)?$", 1)
    return strip(F.when(strip(reply).startswith("```"), inner).otherwise(reply))


def canonical_key(subject: Column, predicate: Column, object_: Column) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(object_.alias("object"), predicate.alias("predicate"), subject.alias("subject")), {"ignoreNullFields": "false"})


def fact_text(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws(" ", subject, predicate, object_)


def chain_key(subject: Column, predicate: Column) -> Column:
    return F.concat_ws("|", subject, predicate)


def verdict(reply: Column) -> Column:
    """struct<contradicts, confidence, reason>; confidence within 0 and 1, 0 where absent; null where the reply is no verdict."""
    got = F.from_json(strip_fence(reply), "contradicts boolean, confidence string, reason string")
    number = F.expr("1").cast("double") * F.coalesce(got["confidence"], F.lit("0")).try_cast("double")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))
    return F.when(got["contradicts"].isNotNull() & number.isNotNull(), F.struct(got["contradicts"].alias("contradicts"), clamped.alias("confidence"), F.coalesce(got["reason"], F.lit("")).alias("reason")))


def shown(text: Column, longest: int = 1000) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("\n... [truncated]"))).otherwise(text)


def result_text(rank: Column, project: Column, collection: Column, path: Column, distance: Column, version: Column, text: Column, longest: int = 2000) -> Column:
    """A hit as a block of text: a line with its place, collection, file, distance (if a vector was met) and freshness, then its text, cut."""
    near = F.when(distance.isNotNull(), F.format_string(" (distance: %.4f)", distance)).otherwise("")
    known = F.concat(F.lit("--- Result "), rank.cast("string"), F.lit(" ["), F.coalesce(project, F.lit("?")), F.lit(":"), F.coalesce(collection, F.lit("?")), F.lit("] "), F.coalesce(path, F.lit("?")))
    return F.concat(known, near, F.lit(" ["), freshness_tag(version), F.lit("] ---\n"), shown(text, longest))
