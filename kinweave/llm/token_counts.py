"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie of pieces that begin a word and pieces that continue one.
When no edge leaves a node for the next character, a failure link leads to the node
that stands for what is left after the longest matches so far are taken off, and the
number of tokens taken off is stored with the link (Song et al., "Fast WordPiece
Tokenization", 2021). So a word of n characters costs O(n), and no piece is built.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose counts a worker keeps before it starts anew.
KEPT_WORDS = 400_000
_UNKNOWN = (1 << 40) + 1  # one unknown word, one token


class LongestMatch:
    """Token counts of single words under greedy longest match. An empty initial
    piece is the bare word mark: one token where no longer piece begins the word."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]  # 0: start of a word, 1: within one
        self.fail = [-1, -1]
        self.pops = [0, 0]
        ends = set()
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                v = root
                for c in piece:
                    if c not in self.edges[v]:
                        self.edges[v][c] = len(self.edges)
                        self.edges.append({})
                        self.fail.append(-1)
                        self.pops.append(0)
                    v = self.edges[v][c]
                if piece:
                    ends.add(v)
                elif root == 0:  # the bare word mark: a token, then the rest of the word continues it
                    self.fail[0], self.pops[0] = 1, 1
        todo = deque([0, 1])
        while todo:
            u = todo.popleft()
            for c, v in self.edges[u].items():
                if v in ends:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, taken = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.edges[z]:
                        taken += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.edges[z][c], taken
                todo.append(v)

    def count(self, word: str) -> int:
        """Tokens of a word; 0 if some part of it matches no piece."""
        v, n = 0, 0
        edges, fail, pops = self.edges, self.fail, self.pops
        for c in word:
            while c not in edges[v]:
                if fail[v] < 0:
                    return 0
                n += pops[v]
                v = fail[v]
            v = edges[v][c]
        while v > 1:
            if fail[v] < 0:
                return 0
            n += pops[v]
            v = fail[v]
        return n


class _Kept(dict):
    """Counts by word, made when first asked for."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        found = self.automaton.count(word) or _UNKNOWN
        if len(word) <= 64:
            self[word] = found
        return found


@functools.lru_cache(maxsize=2)
def load(path: str) -> _Kept:
    """The automaton of a sentencepiece model's pieces: those that begin with its
    word mark (the bare mark among them) start words, the others continue them. Byte
    pieces name bytes, not text, and are left out, so a character that no piece has
    makes its word unknown."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return _Kept(LongestMatch([p[1:] for p in plain if p[0] == "▁"], [p for p in plain if p[0] != "▁"]))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) of every whole text: words part at white
    space; a word that greedy longest match cannot cover is one unknown token. Null
    and empty texts have no tokens. Rows with equal ids are rows of their own; other
    columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = load(vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                total = sum(map(kept.__getitem__, words))
                rows.append((len(words), total & ((1 << 40) - 1), total >> 40))
            n = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in n)], names=["id", "n_words", "n_tokens", "n_unknown"])

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
