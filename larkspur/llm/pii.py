"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, identifier cues and the digit pairs that an address, number
or account must have. A local parser then expands each anchor to the whole span and validates it. No parser looks at a
character more than a few times, so that long texts without spaces cost no more than others.

Base spans are those of the kinds' patterns, leftmost and non-overlapping. Added spans: card numbers inside a run of
digits that fails as a whole, account numbers after an identifier cue (an IBAN with its check digits, or 6 to 20
digits), and user names with passwords in a scheme's address.

Edge cases: a null or empty text has no spans; a repeated row is told again; an empty table gives an empty result;
offsets are code points, ends exclusive; other columns are not read or, in redact, stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "login")
#: Words after which a number is an account: fixed values.
CUES = ("iban", "account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?:\s?(?:no|nr|number|nummer)\b\.?)?[\s:#=.]{1,3}(?:([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})|([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9]))(?![A-Za-z])")
_LOGIN = re.compile(r"[^\s/@:?#]+:[^\s/@?#]+(?=@)")
_GROUP = re.compile(r"[0-9]+")

Span = tuple[str, int, int]
_automaton = None


def anchors():
    """The automaton of all anchors; made once in each worker."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for a in "0123456789":
            made.add_word(f"+{a}", ("phone", 2))
            for b in "0123456789":
                made.add_word(f"{a}.{b}", ("ip", 3))
                for gap in ("", " ", "-"):
                    made.add_word(f"{a}{gap}{b}", ("card", 2 + len(gap)))
        made.add_word("@", ("email", 1))
        made.add_word("://", ("login", 3))
        for cue in CUES:
            for word in (cue, cue.upper(), cue.capitalize()):
                made.add_word(word, ("account", len(word)))
        made.make_automaton()
        _automaton = made
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def is_iban(value: str) -> bool:
    text = value.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip(".").lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _inner_cards(run: str, at: int) -> Iterator[Span]:
    """Whole groups of digits in a run that together are a valid card number, leftmost first."""
    groups = [m.span() for m in _GROUP.finditer(run)]
    k = 0
    while k < len(groups):
        size, end = 0, k
        while end < len(groups) and size < 16:
            size += groups[end][1] - groups[end][0]
            end += 1
        a, b = groups[k][0], groups[end - 1][1]
        if 16 <= size <= 19 and (b - a < len(run)) and luhn("".join(c for c in run[a:b] if c in _DIGITS)):
            yield "card", at + a, at + b
            k = end
        else:
            k += 1


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added ones, each by kind and start."""
    base: dict[str, list[Span]] = {k: [] for k in BASE_KINDS}
    added: list[Span] = []
    floor = dict.fromkeys(("email", "ip", "card", "phone", "account"), 0)
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "email":
            start = at
            while start > floor["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                base["email"].append(("email", start, m.end()))
                floor["email"] = m.end()
        elif kind == "ip":
            if at < floor["ip"]:
                continue
            start = at
            while start > floor["ip"] and text[start - 1] in _DIGITS:
                start -= 1
            if m := _IP.match(text, start):
                floor["ip"] = m.end()
                if all(_small(p) for p in m[0].split(".")):
                    base["ip"].append(("ip", start, m.end()))
        elif kind == "card":
            if at < floor["card"]:
                continue
            m = _CARD.match(text, at)
            floor["card"] = m.end()
            if m.end() - at < 16:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                base["card"].append(("card", at, m.end()))
            elif len(digits) >= 16:
                added += _inner_cards(m[0], at)
        elif kind == "phone":
            if at >= floor["phone"] and (m := _PHONE.match(text, at)):
                floor["phone"] = m.end()
                if 8 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    base["phone"].append(("phone", at, m.end()))
        elif kind == "account":
            if at >= floor["account"] and not (at and text[at - 1].isalnum()) and (m := _NUMBER.match(text, last + 1)):
                for k in (1, 2):
                    if m[k] and (k == 2 or is_iban(m[k])):
                        added.append(("account", m.start(k), m.end(k)))
                        floor["account"] = m.end()
        elif m := _LOGIN.match(text, last + 1):
            added.append(("login", m.start(), m.end()))
    order = {k: i for i, k in enumerate(KINDS)}
    return [s for k in BASE_KINDS for s in base[k]], sorted(added, key=lambda s: (order[s[0]], s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """text with a mark of the first kind in place of every stretch that spans cover."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, the counts of base spans by kind, base_sha256 and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            counts, digests, told = [], [], []
            for t in batch.column(1):
                base, added = find_spans(t.as_py() or "")
                counts.append([sum(s[0] == k for s in base) for k in BASE_KINDS])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                told.append(joined(sorted(base + added, key=lambda s: (order[s[0]], s[1]))))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE_KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(told, pa.string())], [doc, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    schema = f"`{doc}` {docs.schema[doc].dataType.simpleString()}, {', '.join(f'n_{k} long' for k in BASE_KINDS)}, base_sha256 string, spans string"
    return docs.select(F.col(doc), F.col(text)).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with marks in place of personal data; n_chars, where docs has it, follows. Null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redacted(t, [s for part in find_spans(t) for s in part]))

    out = docs.withColumn(text, clean(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(text).isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
