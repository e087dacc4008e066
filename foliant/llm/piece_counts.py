"""Greedy word-piece counts by a linear longest-match automaton (operator 7).

A text's words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, as UTF-8 bytes
and a mark for the word's end. The vocabulary's pieces make a trie over bytes and
that mark. Each node has a failure link and the number of pieces that are popped
when it is followed: the pieces that longest-match-first has settled by then. A
word is read once, left to right; where a node has no branch for the next byte,
its pops are counted and its link followed. Pieces themselves are never built.

The end mark alone costs nothing (a last piece needs none); a byte that the
vocabulary lacks is a piece of its own. Words repeat, so a worker keeps counts
of those it has met, up to a bound; the others are walked together, one
position of all words at a time, but for very long ones (text without white
space), each of which is walked alone.

Defined results: null and empty texts have no pieces; repeated rows are counted
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.llm.common import text_of
from foliant.llm.tokens import vocabulary
from foliant.llm.words import texts_of

#: Symbols: 256 bytes and the end of a word.
END = 256
SYMBOLS = 257
#: Words whose counts a worker keeps at most.
KEPT_WORDS = 500_000
#: Longer words (texts without white space) walk the automaton alone, and aren't kept.
LONG = 256


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones
    for themselves, the others by the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def pieces_of(path: str, suffix: str = "</w>") -> list[tuple[int, ...]]:
    """The vocabulary's pieces as symbols."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    special = {x["content"] for x in held.get("added_tokens", [])}
    letters = byte_letters()
    out = []
    for piece in held["model"]["vocab"]:
        if piece in special:
            continue
        body = piece.removesuffix(suffix)
        if body and all(c in letters for c in body):
            out.append((*(letters[c] for c in body), *([END] if piece != body else [])))
    return out


class Automaton:
    """Trie with failure links and counts of popped pieces."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        cost = [-1]  # of the piece that ends at a node; -1: none does
        for piece in [*((b,) for b in range(256)), *pieces, (END,)]:
            at = 0
            for symbol in piece:
                if symbol not in children[at]:
                    children[at][symbol] = len(children)
                    children.append({})
                    cost.append(-1)
                at = children[at][symbol]
            cost[at] = 0 if piece == (END,) else 1
        fail, pops = [0] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for symbol, node in children[parent].items():
                queue.append(node)
                if cost[node] >= 0:
                    fail[node], pops[node] = 0, cost[node]
                    continue
                popped, at = pops[parent], fail[parent]
                while symbol not in children[at]:  # the root has every symbol
                    popped += pops[at]
                    at = fail[at]
                fail[node], pops[node] = children[at][symbol], popped
        self.fail, self.pops = np.array(fail), np.array(pops)
        edges = sorted((at * SYMBOLS + symbol, node) for at, x in enumerate(children) for symbol, node in x.items())
        self.keys, self.nodes = (np.array(x, dtype=np.int64) for x in zip(*edges, strict=True))
        self.edges, self.links = dict(edges), (pops, fail)

    def count_long(self, word: bytes) -> int:
        """Pieces of one word, a step a byte."""
        edge, (pops, fail) = self.edges.get, self.links
        state = count = 0
        for symbol in chain(word, (END,)):
            node = edge(state * SYMBOLS + symbol)
            while node is None:  # the root has every symbol
                count += pops[state]
                state = fail[state]
                node = edge(state * SYMBOLS + symbol)
            state = node
        while state:
            count += pops[state]
            state = fail[state]
        return count

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word: short ones walk side by side, a step a position."""
        out = np.zeros(len(words), dtype=np.int64)
        short = [k for k, x in enumerate(words) if len(x) <= LONG]
        out[short] = self._counts_together([words[k] for k in short])
        for k, x in enumerate(words):
            if len(x) > LONG:
                out[k] = self.count_long(x)
        return out

    def _counts_together(self, words: list[bytes]) -> np.ndarray:
        sizes = np.array([len(x) for x in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")  # words that reach a position come first
        sizes, starts = sizes[order], starts[order]
        state, count = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        for position in range(int(sizes.max(initial=0)) + 1):
            n = int(np.searchsorted(-sizes, -position, side="right"))  # their size is position or more
            symbol = np.full(n, END)
            inside = int(np.searchsorted(-sizes[:n], -position, side="left"))
            symbol[:inside] = data[starts[:inside] + position]
            todo = np.arange(n)
            while len(todo):
                at = state[todo]
                from_root = at == 0
                key = at * SYMBOLS + symbol[todo]
                place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                there = self.keys[place] == key
                state[todo[there]] = self.nodes[place[there]]
                todo = todo[~there & ~from_root]
                count[todo] += self.pops[state[todo]]
                state[todo] = self.fail[state[todo]]
        while state.any():
            count += self.pops[state]
            state = self.fail[state]
        out = np.empty_like(count)
        out[order] = count
        return out


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(pieces_of(path))


_kept: dict[str, dict[bytes, int]] = {}


def count_pieces(texts: list[bytes], path: str) -> list[tuple[int, int]]:
    """Words and pieces of each text."""
    kept = _kept.setdefault(path, {})
    out: list[tuple[int, int]] = []
    size, part = 0, []
    for k, text in enumerate(texts):
        part.append(text.lower().split())
        size += len(text)
        if size >= 4 << 20 or k + 1 == len(texts):
            if len(kept) > KEPT_WORDS:
                kept.clear()
            new = list(set().union(*part).difference(kept))
            if new:
                kept.update(zip(new, automaton(path).counts(new).tolist(), strict=True))
            get = kept.__getitem__
            out += [(len(words), sum(map(get, words))) for words in part]
            for word in [x for x in new if len(x) > LONG]:
                del kept[word]
            size, part = 0, []
    return out


def piece_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_pieces of each row."""
    file = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_pieces(texts_of(batch), file)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))], ["doc_id", "n_words", "n_pieces"])

    return text_of(docs).mapInArrow(run, "doc_id long, n_words long, n_pieces long")
