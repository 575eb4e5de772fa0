"""Token counts by a linear longest-match automaton.

The vocabulary's trie gets a failure link and a count for each node: where no edge goes on, the link leads to the node
for what is left once the longest pieces are popped, and the count says how many were popped. Greedy word pieces are
then counted in one pass over a word's characters, without building a piece.

Pieces that start with the word mark begin a word, all others continue one. A word that can't be built from pieces is
one unknown token.

Edge cases: a null, empty or blank text has no tokens; repeated rows are counted each for itself; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import table

MARK = "▁"
#: A word: letters, digits and underscores, or one other character that isn't white space.
_WORD = re.compile(r"\w+|[^\w\s]")
#: Words whose counts a worker remembers.
_REMEMBERED = 500_000


class LongestMatch:
    BEGIN, INSIDE, NONE = 0, 1, -1

    def __init__(self, pieces: list[str], mark: str = MARK):
        self.edge: dict[tuple[int, str], int] = {}
        parent, last, is_piece = [self.NONE, self.NONE], ["", ""], [False, False]
        for piece in pieces:
            node, rest = (self.BEGIN, piece[len(mark) :]) if piece.startswith(mark) else (self.INSIDE, piece)
            for c in rest:
                to = self.edge.get((node, c))
                if to is None:
                    to = self.edge[node, c] = len(parent)
                    parent.append(node)
                    last.append(c)
                    is_piece.append(False)
                node = to
            if rest:
                is_piece[node] = True
        self.link, self.pops = [self.NONE] * len(parent), [0] * len(parent)
        after: list[list[int]] = [[] for _ in parent]
        for node in range(2, len(parent)):
            after[parent[node]].append(node)
        queue = deque(after[self.BEGIN] + after[self.INSIDE])
        while queue:
            node = queue.popleft()
            queue.extend(after[node])
            if is_piece[node]:
                self.link[node], self.pops[node] = self.INSIDE, 1
                continue
            up = parent[node]
            back, popped = self.link[up], self.pops[up]
            while back != self.NONE and (back, last[node]) not in self.edge:
                popped += self.pops[back]
                back = self.link[back]
            if back != self.NONE:
                self.link[node], self.pops[node] = self.edge[back, last[node]], popped

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it is unknown."""
        node, total = self.BEGIN, 0
        edge, link, pops = self.edge, self.link, self.pops
        for c in word:
            while (to := edge.get((node, c))) is None:
                if link[node] == self.NONE:
                    return 0
                total += pops[node]
                node = link[node]
            node = to
        while node != self.INSIDE:
            if link[node] == self.NONE:
                return 0
            total += pops[node]
            node = link[node]
        return total


def count_tokens(docs: DataFrame, pieces: list[str], doc: str = "doc_id", text: str = "text", mark: str = MARK) -> DataFrame:
    """doc, n_words, n_tokens and n_unknown of every row; an unknown word is one token."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = LongestMatch(shared.value, mark), {}
        for batch in batches:
            words, tokens, unknown = [], [], []
            for t in batch.column(1):
                w = total = bad = 0
                for word, n in Counter(_WORD.findall(t.as_py() or "")).items():
                    k = known.get(word)
                    if k is None:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        k = known[word] = automaton.count(word)
                    w += n
                    total += n * (k or 1)
                    bad += 0 if k else n
                words.append(w)
                tokens.append(total)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], [doc, "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(doc), F.col(text)).mapInArrow(run, f"`{doc}` {docs.schema[doc].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long")


def sentencepiece_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece file without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), sentencepiece_pieces(public_tokenizers.path("piece_bpe_32k.model")))
