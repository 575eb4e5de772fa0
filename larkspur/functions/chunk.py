"""Chunks of code and documents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from larkspur.functions.text import strip

CODE_LINES, CODE_OVERLAP = 200, 50
LEAST_CHARS, MOST_SECTION_LINES = 30, 200
MOST_DECLARATION_LINES, LEAST_DECLARATION_LINES, DEEPEST = 500, 5, 4
#: Declarations by file extension that begin a chunk: fixed values.
DECLARATIONS = {
    ".cs": ("class", "struct", "interface", "enum", "record"),
    ".ts": ("class", "function", "interface", "enum", "type", "export"),
    ".tsx": ("class", "function", "interface", "enum", "type", "export"),
}


def line_windows(df: DataFrame, text: str = "text", lines: int = CODE_LINES, overlap: int = CODE_OVERLAP) -> DataFrame:
    """Adds chunk_index, start_line, end_line (from 1, inclusive) and chunk for windows of lines; blank texts have none.

    The window that reaches the end is the last: no tail of overlap alone follows.
    """
    if overlap >= lines:
        raise ValueError("overlap must be less than the lines of a chunk")
    step = lines - overlap
    split = df.withColumn("__lines", F.split(F.col(text), "\n")).filter(strip(F.col(text)) != "")
    last = F.ceil(F.greatest(F.lit(0), F.size("__lines") - lines) / step).cast("int")
    rows = split.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.withColumns({"start_line": start + 1, "end_line": F.least(start + lines, F.size("__lines")), "chunk": F.array_join(F.slice("__lines", start + 1, lines), "\n")}).drop("__lines")


def _paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), "\n{2,}"), strip), lambda p: p != "")


def _body(section: Column) -> Column:
    """A section without its leading heading line."""
    return strip(F.regexp_replace(strip(section), r"^#{1,3}[ \t\x0b\f\r]+[^\n]+(\n|$)", ""))


def document_chunks(df: DataFrame, text: str = "text", least: int = LEAST_CHARS, most_lines: int = MOST_SECTION_LINES) -> DataFrame:
    """Adds title, chunk_index and chunk: sections by H1 and H2 headings, or else paragraphs.

    A long section is split by paragraphs, of which short ones go; a section without a body goes. Documents with only
    H3 headings are one section with the first one's title.
    """
    mark = "\x00"
    head = r"(?m)^(#{1,2}\s+.+)$"
    raw = F.col(text)
    pieces = F.filter(F.split(F.regexp_replace(raw, head, mark + "$1"), mark), lambda s: strip(s) != "")
    # Java's $ and . would stop at other line ends too, so titles are cut at newlines alone
    titled = lambda s: F.when(s.rlike(r"(?s)^#{1,2}\s+.+"), strip(F.regexp_extract(s, r"^#{1,2}\s+([^\n]+)", 1))).otherwise(F.lit("untitled"))
    section = lambda title, body: F.struct(title.alias("title"), body.alias("body"))
    by_heading = F.transform(pieces, lambda s: section(titled(s), s))
    third = F.array(section(strip(F.regexp_extract(raw, r"(?m)^#{3}\s+(.+)$", 1)), raw))
    plain = F.transform(_paragraphs(raw), lambda p: section(F.lit("untitled"), p))
    has_head, has_third = raw.rlike(head), raw.rlike(r"(?m)^#{3}\s+(.+)$")
    sections = F.when(has_head, by_heading).when(has_third, third).otherwise(plain)
    headed = has_head | has_third

    def cut(s: Column) -> Column:
        long = F.size(F.split(s["body"], "\n")) > most_lines
        parts = F.transform(F.filter(_paragraphs(s["body"]), lambda p: F.length(p) >= least), lambda p: section(s["title"], p))
        whole = F.when(headed & (_body(s["body"]) == ""), F.array().cast("array<struct<title:string,body:string>>")).otherwise(F.array(section(s["title"], strip(s["body"]))))
        return F.when(long, parts).otherwise(whole)

    kept = F.flatten(F.transform(sections, cut))
    rows = df.filter(strip(raw) != "").select("*", F.posexplode(kept).alias("chunk_index", "__s"))
    return rows.withColumns({"title": F.col("__s.title"), "chunk": F.col("__s.body")}).drop("__s")


#: What ends a run of plain code: quotes, slashes, braces, and in C# lines of the preprocessor.
_STOPS = {True: re.compile(r"""[$@]*"|'|/[/*]|[{}]|^[ \t]*#[^\n]*""", re.MULTILINE), False: re.compile(r"""["'`{}]|/""")}
#: Words after which a slash begins a regular expression, as an operator or an opening bracket does; a slash behind < ends a tag.
_BEFORE_PATTERN = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|in|of|delete|void|throw|new|instanceof|yield|await|else|do)\s*$|[(,=:\[!&|?{};+\-*%~^>]\s*$|^\s*$")
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_LINE_STRING = {'"': re.compile(r'"(?:\\.|[^"\\\n])*"'), "'": re.compile(r"'(?:\\.|[^'\\\n])*'")}

_RUN = {'"': re.compile('"+'), "{": re.compile(r"\{+")}


def _hole(text: str, at: int, kind: tuple) -> tuple[int, bool]:
    """Where a string of this kind that is open at `at` goes on: (place behind its end, False) or (place in a hole with code, True)."""
    name, quotes, dollars = kind
    while at < len(text):
        c = text[at]
        if name == "template":
            if c == "`":
                return at + 1, False
            if text.startswith("${", at):
                return at + 2, True
            at += 2 if c == "\\" else 1
        elif name == "raw":
            run = _RUN[c].match(text, at).end() - at if c in _RUN else 1
            if c == '"' and run >= quotes:
                return at + run, False
            if c == "{" and dollars and run >= dollars:
                return at + run, True
            at += run
        else:
            if c == '"' and name == "verbatim" and text.startswith('""', at):
                at += 2
            elif c == '"' or (c == "\n" and name == "plain"):
                return at + 1, False
            elif c == "{" and dollars:
                if not text.startswith("{{", at):
                    return at + 1, True
                at += 2
            else:
                at += 2 if c == "\\" and name == "plain" else 1
    return at, False


def quieted(text: str, extension: str) -> str:
    """text with blanks in place of comments, strings, characters, templates and regular expressions; line ends stay.

    Strings with holes (templates, interpolated strings) are left for the code in a hole and taken up again behind it, from a
    stack; a hole's braces are none of the file's. A quote that nothing closes on its line is a sign like others.
    """
    sharp = extension == ".cs"
    out, kept, at, holes = [], 0, 0, []  # holes: [kind of the string around, open braces]

    def blank(a: int, b: int) -> None:
        nonlocal kept
        out.append(text[kept:a] if not holes else re.sub(r"[^\n]", " ", text[kept:a]))
        out.append(re.sub(r"[^\n]", " ", text[a:b]))
        kept = b

    def string(a: int, b: int, kind: tuple) -> int:
        """Takes a string from its opening a to b on, to its end or next hole."""
        end, hole = _hole(text, b, kind)
        blank(a, end)
        if hole:
            holes.append([kind, kind[2] if kind[0] == "raw" else 1])
        return end

    while found := _STOPS[sharp].search(text, at):
        a, mark = found.start(), found[0]
        at = found.end()
        if mark in "{}":
            if holes:
                holes[-1][1] += 1 if mark == "{" else -1
                if not holes[-1][1]:
                    blank(kept, at)  # the code in the hole
                    kind, _ = holes.pop()
                    at = string(kept, at, kind)
        elif text.startswith(("//", "/*"), a):
            end = text.find("\n", a) if text[a + 1] == "/" else text.find("*/", a + 2)
            at = len(text) if end < 0 else end + (2 if text[a + 1] == "*" else 0)
            blank(a, at)
        elif mark == "/":
            if _BEFORE_PATTERN.search(text[max(kept, a - 60) : a]) and (m := _PATTERN.match(text, a)):
                at = m.end()
                blank(a, at)
        elif mark == "`":
            at = string(a, at, ("template", 0, 1))
        elif sharp and mark.endswith('"') and text.startswith('"""', at - 1):
            run = _RUN['"'].match(text, at - 1).end() - at + 1
            at = string(a, at - 1 + run, ("raw", run, mark.count("$")))
        elif sharp and mark[0] in "$@":
            at = string(a, at, ("verbatim" if "@" in mark else "plain", 1, mark.count("$")))
        elif sharp and mark.lstrip().startswith("#"):
            blank(a, at)
        elif m := _LINE_STRING[mark].match(text, a):
            at = m.end()
            blank(a, at)
    blank(len(text), len(text))
    return "".join(out)


def declarations(text: str, extension: str) -> list[tuple[int, int]]:
    """First and last line (from 0) of outer declarations, by counting braces outside strings and comments.

    Stands in for a syntax tree, whose parser is an optional library; a declaration inside another belongs to it.
    """
    words = DECLARATIONS.get(extension, ())
    if not words:
        return []
    quiet = quieted(text, extension)
    begins = re.compile(rf"^\s*(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|async|declare|default|unsafe|file)\s+)*(?:{'|'.join(words)})\b")
    found, depth, open_at, open_depth, seen = [], 0, None, 0, False
    for n, line in enumerate(quiet.split("\n")):
        if open_at is None and depth <= DEEPEST and begins.match(line):
            open_at, open_depth, seen = n, depth, False
        for c in line:
            if c == "{":
                depth += 1
                seen = True
            elif c == "}":
                depth -= 1
        if open_at is not None and ((seen and depth <= open_depth) or (not seen and line.rstrip().endswith(";"))):
            found.append((open_at, n))
            open_at = None
    if open_at is not None:
        found.append((open_at, quiet.count("\n")))
    return found


def declaration_chunks(text: str, extension: str, most: int = MOST_DECLARATION_LINES, lines: int = CODE_LINES, overlap: int = CODE_OVERLAP) -> list[tuple[int, int, int, str]]:
    """(chunk_index, start_line, end_line, chunk): regions of declarations; small neighbours together, long ones in windows."""
    if not text.strip():
        return []
    all_lines = text.split("\n")

    def windows(a: int, b: int) -> list[tuple[int, int]]:
        out, at = [], a
        while True:
            out.append((at, min(at + lines, b)))
            if at + lines >= b:
                return out
            at += lines - overlap

    regions: list[list[int]] = []
    for a, b in sorted(declarations(text, extension)):
        if regions and a - regions[-1][1] <= 2 and b - regions[-1][0] + 1 < 3 * LEAST_DECLARATION_LINES:
            regions[-1][1] = max(b, regions[-1][1])
        else:
            regions.append([a, b])
    if regions:
        starts = [0, *(r[0] for r in regions[1:])]
        spans = list(zip(starts, [*starts[1:], len(all_lines)], strict=True))
    else:
        spans = [(0, len(all_lines))]
    limit = most if regions else 0
    cut = reduce(lambda acc, s: acc + (windows(*s) if s[1] - s[0] > limit else [s]), spans, [])
    return [(k, a + 1, b, "\n".join(all_lines[a:b])) for k, (a, b) in enumerate(cut)]


@udtf(returnType="chunk_index int, start_line int, end_line int, chunk string")
class DeclarationChunks:
    """Table function over (text, extension) and the lines from which a declaration is cut into windows."""

    def eval(self, text: str, extension: str, most: int = MOST_DECLARATION_LINES):
        yield from declaration_chunks(text or "", extension or "", most)
