"""Word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie whose nodes carry a failure link and the number of pieces that are popped when the link
is followed. A word is read once, sign by sign; no piece is built. The counts are those of the greedy
longest-match rule: first piece from the initial pieces, later ones from the continuing pieces, and one
unknown piece for a word that cannot be cut.

Words lie between white space. The default vocabulary is that of the public piece model: pieces that open a
word are initial, the others continuing.

Defined results: a null or blank text has no words and no pieces; repeated rows give repeated rows; an empty
table gives no rows; a word of any length takes time in proportion to it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from gridwarden.llm.common import per_row

VOCABULARY = "piece_bpe_32k.model"
_OPENING = "▁"
#: Words whose counts a worker remembers; beyond it the memory is emptied.
_REMEMBERED = 200_000


@lru_cache(maxsize=2)
def load_pieces(path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Initial and continuing pieces of a piece model; bytes and control pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    initial, continuing = [], []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or _OPENING in piece[1:]:
            continue
        if piece.startswith(_OPENING):
            if piece != _OPENING:
                initial.append(piece[1:])
        else:
            continuing.append(piece)
    return tuple(initial), tuple(continuing)


class Matcher:
    """Trie of both kinds of pieces with failure links and popped counts."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # 0: before a word; 1: after a piece
        piece = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for text in pieces:
                node = root
                for c in text:
                    if c not in self.next[node]:
                        self.next[node][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    node = self.next[node][c]
                if node > 1:
                    piece[node] = True
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        level = [0, 1]
        while level:
            following = []
            for parent in level:
                for c, node in self.next[parent].items():
                    following.append(node)
                    if piece[node]:
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and c not in self.next[at]:
                        count, at = count + self.popped[at], self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.next[at][c], count
            level = following

    def count(self, word: str) -> int:
        """Pieces of a word; 0 if it cannot be cut."""
        step, fail, popped = self.next, self.fail, self.popped
        node = total = 0
        for c in word:
            while (to := step[node].get(c)) is None:
                total += popped[node]
                node = fail[node]
                if node < 0:
                    return 0
            node = to
        while node > 1:
            total += popped[node]
            node = fail[node]
        return total if node == 1 else 0


@lru_cache(maxsize=2)
def load_matcher(path: str) -> Matcher:
    return Matcher(*load_pieces(path))


def count_pieces(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), path: str | None = None) -> DataFrame:
    """``keep`` columns, n_words, n_tokens (an unknown word counts as one), n_unknown."""
    file = path or public_tokenizers.path(VOCABULARY)

    def setup():
        matcher = load_matcher(file)
        known: dict[str, int] = {}

        def one(value):
            words = (value or "").split()
            total = unknown = 0
            for w in words:
                n = known.get(w)
                if n is None:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    n = matcher.count(w)
                    if len(w) <= 64:
                        known[w] = n
                if n:
                    total += n
                else:
                    unknown += 1
            return len(words), total + unknown, unknown

        return lambda texts: list(zip(*map(one, texts), strict=True)) or [[], [], []]

    return per_row(df, setup, "n_words long, n_tokens long, n_unknown long", [text], keep)
