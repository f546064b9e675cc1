"""Greedy word-piece counts in linear time (operator 2), after Song et al., "Fast WordPiece Tokenization" (2021).

The vocabulary is a trie. Every node has a failure link, to where matching goes on when no edge fits, and the number of pieces
that following the link completes. Counting reads each character once and adds numbers; pieces are never built.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import small_batches

#: Marks the start of a word in the vocabulary file (a fixed value of its format).
WORD_START = "▁"
MOST_WORDS = 500_000
_counters: dict = {}


class PieceCounter:
    """first: pieces that may start a word; later: pieces that may follow."""

    def __init__(self, first: set[str], later: set[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # node 0: start of a word; node 1: start of a later piece
        ends = [False, False]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                node = root
                for c in piece:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    node = self.next[node][c]
                if piece:
                    ends[node] = True
        self.fail: list[int | None] = [None] * len(self.next)
        self.popped = [0] * len(self.next)
        level = [0, 1]
        while level:  # breadth first: the links of shorter strings are there before longer ones need them
            below = []
            for node in level:
                for c, child in self.next[node].items():
                    below.append(child)
                    if ends[child]:
                        self.fail[child], self.popped[child] = 1, 1
                        continue
                    z, n = self.fail[node], self.popped[node]
                    while z is not None and c not in self.next[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z is not None:
                        self.fail[child], self.popped[child] = self.next[z][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word by greedy longest match; 0 if it cannot be cut into pieces."""
        node, n = 0, 0
        for c in word:
            while c not in self.next[node]:
                if (to := self.fail[node]) is None:
                    return 0
                n += self.popped[node]
                node = to
            node = self.next[node][c]
        while node > 1:
            if (to := self.fail[node]) is None:
                return 0
            n += self.popped[node]
            node = to
        return n


def vocabulary(path: str) -> tuple[set[str], set[str]]:
    """Pieces that start a word and pieces that follow, from a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p[1:] for p in pieces if p.startswith(WORD_START) and len(p) > 1}, {p for p in pieces if not p.startswith(WORD_START)}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(*vocabulary(path))
    return _counters[path]


def piece_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_pieces, n_unknown): words are runs of anything but ASCII blanks; a word without a cut counts as one piece.

    Null or blank texts count 0. One output row per input row; other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    blanks = re.compile(r"[\x20\x09-\x0D]+")

    def run(batches):
        pieces, known = counter(path), {}
        for batch in batches:
            words, counts, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                if len(known) > MOST_WORDS:
                    known = {}
                n = bad = 0
                cut = [w for w in blanks.split(text or "") if w]
                for w in cut:
                    k = known.get(w)
                    if k is None:
                        known[w] = k = pieces.count(w)
                    n += k or 1
                    bad += not k
                words.append(len(cut))
                counts.append(n)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words, counts, unknown))], ["id", "n_words", "n_pieces", "n_unknown"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_pieces bigint, n_unknown bigint").withColumnRenamed("id", id_col)
