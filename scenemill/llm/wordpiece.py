"""Token counts by the linear longest-match automaton (Song et al. 2021), without building pieces.

The vocabulary's words starts and continuations form two tries. A node's failure link leads to the
continuation node of what is left once its longest pieces are popped, and the number of pieces popped
is kept with the link, so a word's greedy piece count takes one pass over its characters. A word that
no pieces cover counts as one unknown token.

Cases: words are runs without ASCII white space. Null and empty texts have no words and no tokens. Repeated rows give a row
each. An empty table gives no rows. Other columns are not read. Words of any length take linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keeps_cache, mapped, shared_value

WORD = re.compile(r"[^ \t-\r]+")
UNKNOWN = -1
SLICE, MEMO = 256, 200_000


class Automaton:
    """Greedy longest-match piece counts over a vocabulary of word starts and continuations."""

    def __init__(self, starts: list[str], continuations: list[str]):
        # nodes: transitions, failure link, pieces popped on the link; 0 and 1 are the roots
        self.next: list[dict[str, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((0, starts), (1, continuations)):
            for piece in pieces:
                v = root
                for c in piece:
                    if c not in self.next[v]:
                        self.next[v][c] = len(self.next)
                        self.next.append({})
                        token.append(False)
                    v = self.next[v][c]
                token[v] = token[v] or v > 1
        self.fail, self.pops = [UNKNOWN] * len(self.next), [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.next[u].items():
                    below.append(v)
                    if token[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, popped = self.fail[u], self.pops[u]
                    while z != UNKNOWN and c not in self.next[z]:
                        z, popped = self.fail[z], popped + self.pops[z]
                    if z != UNKNOWN:
                        self.fail[v], self.pops[v] = self.next[z][c], popped
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; UNKNOWN if the pieces don't cover it."""
        nodes, fail, pops, v, n = self.next, self.fail, self.pops, 0, 0
        for c in word:
            while (w := nodes[v].get(c)) is None:
                if fail[v] == UNKNOWN:
                    return UNKNOWN
                n += pops[v]
                v = fail[v]
            v = w
        while v > 1:
            if fail[v] == UNKNOWN:
                return UNKNOWN
            n += pops[v]
            v = fail[v]
        return n


class _Memo(dict):
    def __init__(self, count):
        self.count = count

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        n = self.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


_MEMOS: dict[str, _Memo] = {}
keeps_cache("wordpiece", _MEMOS.clear)


def sentencepiece_vocabulary(path: str, mark: str = "▁") -> tuple[list[str], list[str]]:
    """Word starts (pieces with the mark, without it) and continuations of a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
    starts = [p[1:] for p in pieces if p.startswith(mark) and p[1:] and mark not in p[1:]]
    return starts, [p for p in pieces if mark not in p]


def token_counts(docs: DataFrame, starts: list[str], continuations: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown, longest_word (most pieces of a word) of every row."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ("n_words", "n_tokens", "n_unknown", "longest_word")
    schema = T.StructType([read.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names)])
    vocabulary = shared_value(docs.sparkSession, (starts, continuations))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = vocabulary.id
        if key not in _MEMOS:
            _MEMOS.clear()
            _MEMOS[key] = _Memo(Automaton(*vocabulary.value).count)
        memo = _MEMOS[key]
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                out = []
                for text in part.column(1).to_pylist():
                    counts = list(map(memo.__getitem__, WORD.findall(text or "")))
                    unknown = counts.count(UNKNOWN)
                    out.append((len(counts), sum(counts) + 2 * unknown, unknown, max(max(counts, default=0), int(unknown > 0))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*out))], schema.names)

    return mapped(read, counted, schema, "wordpiece")
