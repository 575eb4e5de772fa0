"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path, so that a page's neighbour there is the one most like it in address. The text
lines of both are aligned by their longest common subsequence, and lines that both have are deleted as furniture of
the site. Two exact checks on the markup follow. A shared line inside the page's article stays, since two articles may
quote the same passage; a line inside a menu, header, footer, sidebar, notice, advert, form or reader comment goes,
shared or not. So where a page has text in an article or main element the markup decides alone, and no lines are
compared; the differencing decides for pages without one: on pages whose menus and adverts differ from one to the next,
shared lines tell little.

Tags are read as HTML5 does: attribute values end at their own quote, a tag at its first > outside a value. A page is
parsed once. Its main text goes on if the markup decides, else its lines; hashes of its lines go along for its neighbours.
Pages are dealt out by ranges of (host, path, page), whose bounds come from a sample of the keys, so that a host with a
third of all pages is spread over tasks. A range ends between two hosts, or else with a page that goes along to the next
range too, so that every page meets the neighbour that it has in the order of all pages, wherever the bounds are: the page
before it on its host, or for the first one the page after it.

Edge cases: a null or empty page, or one without main text, gives the empty string; an unclosed or cut page is read as
far as it goes; null URLs, and those without a host, are one host of empty name, whose pages are ordered by page; equal
pages are compared with each other, and outside an article lose the lines they share unless all of their lines are
shared, which is taken for a copy; an empty page is a neighbour like others and shares nothing; equal URLs are ordered by
page, null first; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table

_S = r"[ \t\n\f\r]"
#: A quoted value ends at its quote, any other at white space or >; = alone begins a name that has no value.
_VALUE = rf"{_S}*+={_S}*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+|(?=>)|\Z)"
_ONE = rf"(?:=[^ \t\n\f\r/>=]*+|[^ \t\n\f\r/>=]++)(?:{_VALUE})?+"
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{_ONE})*+)(?:>|\Z)|</(?=[^A-Za-z])[^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(rf"([^ \t\n\f\r/>=]+){_S}*={_S}*(?:\"([^\"]*)|'([^']*)|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*))")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never main text; those of the second list can hold an article all the same.
FURNITURE = frozenset("nav footer aside head menu select button object svg canvas audio video map".split())
WRAPPERS = frozenset("form fieldset dialog".split())
#: Class names, ids and roles that mark furniture anywhere, and those that do so outside an article alone.
MARKS = frozenset("ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert nav navbar navigation menu sidebar breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe subscription popup modal overlay widget login signup form search complementary footer".split())
OUTSIDE = frozenset("header masthead top bottom contentinfo toolbar dialog copyright legal".split())
#: Of these an article below is a teaser or a reader's comment, so it is furniture too.
HOLDS_NO_ARTICLE = frozenset("nav footer aside head menu comment comments commentlist disqus reply replies respond related recommended".split())
#: Parts that a name may have beside marks and be one: cookie-bar is, market-share and with-sidebar are not.
BESIDE = frozenset("area bar block box button buttons container content group inner item items left link links list main page panel post posts primary right secondary section site wrap wrapper".split())
MAIN_MARKS = frozenset(["main", "articlebody"])


def _labels(attributes: str) -> set[str]:
    """Class names, id, role and itemprop, and the marks in those made of marks and BESIDE alone."""
    out: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role", "itemprop"):
            for name in html.unescape(m[2] or m[3] or m[4] or "").lower().split():
                out.add(name)
                parts = [p for p in _PARTS.split(name) if p]
                marks = {p for p in parts if p in MARKS or p in OUTSIDE}
                if marks and all(p in marks or p in BESIDE for p in parts):
                    out |= marks
    return out


def blocks(page: str) -> list[tuple[str, bool, bool]]:
    """(line, whether in the article, whether in furniture) of every block with text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name; in article; furniture (0 no, 1 yes, 2 yes and holds no article); dropped inside a line
    text: list[str] = []

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if line:
                out.append((line, stack[-1][1] if stack else False, bool(stack and stack[-1][2])))

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if not (stack and stack[-1][3]):
            text.append(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(x[0] in BLOCK for x in stack[k + 1 :]):
                        flush()
                    del stack[k:]
                    break
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
            # a paragraph ends where the next block begins, whatever inline elements are open in it
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    if stack[k][0] == name and name in ("li", "dt", "dd", "td", "th", "tr", "option"):
                        del stack[k:]
                    break
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        article, furniture, inside = stack[-1][1:] if stack else (False, 0, False)
        labels = _labels(m[3]) if "=" in m[3] and name not in ("html", "body") else set()
        begins = name in ("article", "main") or bool(labels & MAIN_MARKS)
        if begins and furniture == 1 and not article:
            furniture = 0
        if not furniture:
            if name in FURNITURE or name in WRAPPERS or labels & MARKS or (not article and (name == "header" or labels & OUTSIDE)):
                furniture = 2 if name in HOLDS_NO_ARTICLE or labels & HOLDS_NO_ARTICLE else 1
                # a line goes on where such an element ends inside it
                inside = inside or name not in BLOCK
        if name in BLOCK:
            inside = False
        stack.append((name, article or begins, furniture, inside))
    flush()
    return out


def _row(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of a and b[:j] for every j, by bit vectors."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    whole = (1 << len(b)) - 1
    v = whole
    for x in a:
        if u := v & where.get(x, 0):
            v = ((v + u) | (v - u)) & whole
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(a: list, b: list) -> set[int]:
    """Places in a of a longest common subsequence with b: halves of a against the cut of b that keeps most, linear in memory."""
    found: set[int] = set()
    in_b, in_a = set(b), set(a)
    places = [i for i, x in enumerate(a) if x in in_b]
    todo = [(places, [x for x in b if x in in_a])]
    while todo:
        mine, other = todo.pop()
        while mine and other and a[mine[0]] == other[0]:
            found.add(mine[0])
            mine, other = mine[1:], other[1:]
        while mine and other and a[mine[-1]] == other[-1]:
            found.add(mine[-1])
            mine, other = mine[:-1], other[:-1]
        if len(mine) == 1 and a[mine[0]] in other:
            found.add(mine[0])
        if len(mine) < 2 or not other:
            continue
        half = len(mine) // 2
        front = _row([a[i] for i in mine[:half]], other)
        back = _row([a[i] for i in mine[half:][::-1]], other[::-1])[::-1]
        cut = int(np.argmax(front + back))
        todo += [(mine[:half], other[:cut]), (mine[half:], other[cut:])]
    return found


def main_text(found: list[tuple[str, bool, bool]]) -> str | None:
    """The lines of the article, or None where the markup doesn't decide."""
    lines = [x for x, article, furniture in found if article and not furniture]
    return "\n".join(lines) if lines or not found else None


def without_shared(lines: list[str], furniture: list[bool], hashes: list[int], neighbour: list[int]) -> str:
    """Lines outside furniture that the neighbour, of which hashes are known, doesn't share."""
    shared = shared_lines(hashes, neighbour)
    if len(shared) == len(lines) == len(neighbour):
        shared = set()  # the neighbour is a copy, which tells nothing of furniture
    return "\n".join(x for i, x in enumerate(lines) if not furniture[i] and i not in shared)


def _hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page, url, text and n_chars of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {c: pages.schema[c].dataType.simpleString() for c in (page, url)}
    types = [to_arrow_type(pages.schema[c].dataType) for c in (page, url)]
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    own = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), host.alias("host"), path.alias("path"), F.col(source).alias("html"))
    spark = pages.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # bounds of ranges only spread the rows, so a sample of the keys is enough
    keys = own.select("host", "path", "page")
    share = min(1.0, 200 * tasks / max(1, keys.count()))
    seen = sorted((r[0], r[1], r[2] is not None, r[2]) for r in keys.sample(share, 17).collect())  # about 200 for each task
    step = max(1, len(seen) // (16 * tasks))
    # (host,) comes before every page of the host; a whole key is that of a page which isn't its host's first
    bounds = sorted({seen[k] if seen[k][0] == seen[k - 1][0] and seen[k] != seen[k - 1] else (seen[k][0],) for k in range(step, len(seen), step)})
    whole = set(bounds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                rows, ranges, shadows, texts, lines, furniture, hashes = [], [], [], [], [], [], []
                for i, (p, h, w, x) in enumerate(zip(*(part.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True)):
                    found, key = blocks(x or ""), (h, w, p is not None, p)
                    text = main_text(found)
                    for n in range(1 + (key in whole)):
                        rows.append(i)
                        ranges.append(bisect_left(bounds, key) + n)
                        shadows.append(bool(n))
                        texts.append(text if not n else "")
                        lines.append([f[0] for f in found] if text is None and not n else [])
                        furniture.append([f[2] for f in found] if text is None and not n else [])
                        hashes.append([_hash(f[0]) for f in found])
                kept = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(shadows, pa.bool_()), *(kept.column(k) for k in range(4)), pa.array(texts, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(furniture, pa.list_(pa.bool_())), pa.array(hashes, pa.list_(pa.int64()))], ["range", "shadow", "page", "url", "host", "path", "text", "lines", "furniture", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # range and host, and hashes, of the page before
        held: tuple | None = None  # the page that waits for its successor

        def told(row: tuple, after: tuple | None) -> list[tuple]:
            (place, shadow, page, url, host, text, lines, furniture, hashes), own = row, row[0:5:4]
            if shadow:
                return []
            if text is None:
                other = before[1] if before and before[0] == own else after[8] if after and after[0:5:4] == own else []
                text = without_shared(lines, furniture, hashes, other)
            return [(page, url, text)]

        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                rows, out = zip(*(batch.slice(low, 500).column(k).to_pylist() for k in ("range", "shadow", "page", "url", "host", "text", "lines", "furniture", "hashes")), strict=True), []
                for row in rows:
                    if held is not None:
                        out += told(held, row)
                        before = (held[0:5:4], held[8])
                    held = row
                if out:
                    yield batch_of(out)
        if held is not None and (out := told(held, None)):
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], types[0]), pa.array([r[1] for r in rows], types[1]), pa.array([r[2] for r in rows], pa.string()), pa.array([len(r[2]) for r in rows], pa.int64())], [page, url, "text", "n_chars"])

    parsed = own.mapInArrow(cut, f"range int, shadow boolean, page {kinds[page]}, url {kinds[url]}, host string, path string, text string, lines array<string>, furniture array<boolean>, hashes array<long>")
    near = parsed.repartition("range").sortWithinPartitions("range", "host", "path", "page", "url")
    return near.mapInArrow(compare, f"`{page}` {kinds[page]}, `{url}` {kinds[url]}, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
