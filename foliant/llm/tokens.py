"""Token ids of whole texts by a public tokenizer file.

Texts are read as items: runs of plain letters (ASCII, Latin-1), runs of ASCII
marks, single digits, and whole words (divided by ASCII white space) that hold
anything else. The tokenizer's own split pattern divides plain words into the same
runs, and none of its rules looks across white space or from one run into the
next, so an item's ids don't depend on what stands around it. Bounds and
64-bit hashes of all items of a chunk are found by array operations; a worker
keeps the ids of the items it has met in a hash table of arrays, up to a bound.
New runs are encoded by the library, many at a time, with the model and without
the normaliser and split pattern, which leave a lower-case run as it is; new
words of the other kind are encoded by the library as they are. Items count as
equal if their hashes are: a table holds some 10^6, so one new item in 10^13 or
so could be taken for another.

A tokenizer file with other rules than those is used as it is, text by text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import xxhash

from foliant.llm.words import SPACE, mix, word_hashes

#: Items after which a worker's table is emptied, and bytes of text that are worked on at once.
KEPT, CHUNK = 1 << 20, 1 << 19
#: Runs to a text that the library gets.
JOINED = 200
#: Longer runs are treated as words of the other kind.
LONGEST = 64

# Rules that items rely on (fixed values of the tokenizer file).
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_WHITE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, dtype=np.uint8)
_KIND[33:127] = _MARK
_KIND[ord("'")] = _ODD  # the split pattern has rules of its own for apostrophes
_KIND[ord("0") : ord("9") + 1] = _DIGIT
for _first, _last in ("AZ", "az"):
    _KIND[ord(_first) : ord(_last) + 1] = _LETTER
_KIND[SPACE] = _WHITE


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tuple:
    """The tokenizer, one for plain runs, and which ids end a run; the latter two are None where the file has other rules."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    whole = Tokenizer.from_file(path)
    rules = json.loads(whole.to_str())
    steps = (rules["normalizer"] or {}).get("normalizers", [])
    splits = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    known = [x["type"] for x in steps] == _NORMALIZERS and splits[0].get("pattern") == {"Regex": _SPLIT}
    if not known or rules["model"].get("end_of_word_suffix") != "</w>":
        return whole, None, None
    runs = Tokenizer.from_file(path)
    runs.normalizer = normalizers.Sequence([])
    runs.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    pieces = whole.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(pieces.values()) + 1, dtype=bool)
    ends[[k for piece, k in pieces.items() if piece.endswith("</w>")]] = True
    return whole, runs, ends


class _Table:
    """Ids by the 64-bit hash of an item, in arrays with open addressing."""

    def __init__(self):
        self._empty(21)

    def _empty(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, dtype=np.uint64)  # 0 is a free slot
        self.places = np.zeros(1 << bits, dtype=np.int32)
        self.starts = np.zeros((1 << bits - 1) + 1, dtype=np.int64)
        self.ids = np.zeros(4 << bits - 1, dtype=np.uint32)

    def turn(self) -> None:
        if self.n > KEPT:
            self._empty(21)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys, -1 where one isn't kept."""
        slots = self._slots(keys)
        there = self.keys[slots]
        places = np.where(there == keys, self.places[slots], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)
            there, wanted = self.keys[slots[left]], keys[left]
            hit = there == wanted
            places[left[hit]] = self.places[slots[left[hit]]]
            left = left[~hit & (there != 0)]
        return places

    def _insert(self, keys: np.ndarray, places: np.ndarray) -> None:
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            mine = self.keys[at] == keys[left]
            self.places[at[mine]] = places[left[mine]]
            slots[left] = (at + 1) & (len(self.keys) - 1)
            left = left[~mine]

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Keep the ids of keys that aren't kept yet, each key once."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            full = np.flatnonzero(self.keys)
            held, places, starts, n = self.keys[full], self.places[full], self.starts[: self.n + 1], self.n
            flat = self.ids
            self._empty(self.bits + 1)
            self.n, self.starts[: n + 1] = n, starts
            self.ids = np.concatenate([flat, np.zeros(max(0, len(self.ids) - len(flat)), dtype=np.uint32)])
            self._insert(held, places)
        first = int(self.starts[self.n])
        if first + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), dtype=np.uint32)])
        self.ids[first : first + len(ids)] = ids
        self._insert(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.starts[self.n + 1 : self.n + len(keys) + 1] = first + np.cumsum(lengths)
        self.n += len(keys)

    def ids_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some items in a row, and the number of each."""
        begin = self.starts[places]
        lengths = self.starts[places + 1] - begin
        after = np.cumsum(lengths)
        total = int(after[-1]) if len(after) else 0
        return self.ids[np.repeat(begin - (after - lengths), lengths) + np.arange(total)], lengths


_kept: dict[str, _Table] = {}


def _items(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, and starts, ends and oddness of the items of some text."""
    a = np.frombuffer(data, dtype=np.uint8)
    low = np.frombuffer(bytearray(data.lower() + b" "), dtype=np.uint8)  # A-Z alone; a blank ends the last item
    kind = _KIND[a]
    lead = np.flatnonzero(a[:-1] == 0xC3)
    if len(lead):
        second = a[lead + 1]
        letter = (second != 0x97) & (second != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        low[lead[letter & (second <= 0x9E)] + 1] += 0x20
    # Special tokens begin so; the library looks for them in words of the other kind.
    kind[np.flatnonzero((a[:-1] == ord("<")) & (a[1:] == ord("|")))] = _ODD
    odd = np.flatnonzero(kind == _ODD)
    edge = np.ones(len(a) + 1, dtype=bool)
    if len(odd):
        inside = kind != _WHITE
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        bounds = np.flatnonzero(edge)
        hit = np.unique(np.searchsorted(bounds, odd, side="right") - 1)
        step = np.zeros(len(a) + 1, dtype=np.int8)
        step[bounds[hit]], step[bounds[hit + 1]] = 1, -1
        kind[np.cumsum(step[:-1], dtype=np.int8).astype(bool)] = _ODD
        edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[1:-1] |= kind[1:] == _DIGIT
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    kinds = kind[starts]
    real = kinds != _WHITE
    starts, ends, kinds = starts[real], ends[real], kinds[real]
    return low, starts, ends, (kinds == _ODD) | (ends - starts > LONGEST)


def _encode_runs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some runs in a row, and the number of each."""
    _, tokenizer, ending = _tokenizer(path)
    sizes = ends - starts + 1
    after = np.cumsum(sizes)
    joined = low[np.repeat(starts - (after - sizes), sizes) + np.arange(int(after[-1]))]
    joined[after - 1] = ord(" ")
    cuts = [0, *after[JOINED - 1 : -1 : JOINED].tolist(), int(after[-1])]
    text = joined.tobytes()
    codes = tokenizer.encode_batch_fast([text[x : y - 1].decode() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)
    ids = np.concatenate([np.array(code.ids, dtype=np.uint32) for code in codes])
    last = np.flatnonzero(ending[ids])
    if len(last) != len(starts):
        raise ValueError("a run isn't one word of the tokenizer")
    return ids, np.diff(last, prepend=-1)


def _encode_chunk(data: bytes, path: str, table: _Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of some text in a row; where its items start, and the number of ids of each."""
    low, starts, ends, odd = _items(data)
    if not len(starts):
        return np.zeros(0, dtype=np.uint32), starts, starts
    table.turn()
    keys = word_hashes(low, starts, ends)
    for k in np.flatnonzero(odd).tolist():
        keys[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    keys[odd] = mix(keys[odd] ^ np.uint64(0x6A09E667F3BCC909))
    keys[keys == 0] = 1
    places = table.find(keys)
    lacking = np.flatnonzero(places < 0)
    if len(lacking):
        new, first = np.unique(keys[lacking], return_index=True)
        at = lacking[first]
        plain, other = ~odd[at], np.flatnonzero(odd[at])
        if plain.any():
            ids, lengths = _encode_runs(low, starts[at[plain]], ends[at[plain]], path)
            table.add(new[plain], lengths, ids)
        if len(other):
            words = [data[starts[k] : ends[k]].decode("utf-8", "replace") for k in at[other].tolist()]
            codes = [np.array(x.ids, dtype=np.uint32) for x in _tokenizer(path)[0].encode_batch_fast(words, add_special_tokens=False)]
            table.add(new[other], np.array([len(x) for x in codes]), np.concatenate(codes))
        places[lacking] = table.find(keys[lacking])
    ids, lengths = table.ids_at(places)
    return ids, starts, lengths


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], bool]]:
    """Texts to be worked on at once: their numbers, bytes, and whether a part begins its text. Long ones are cut at white space."""
    numbers: list[int] = []
    part: list[bytes] = []
    size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > CHUNK:
            yield numbers, part, True
            numbers, part, size = [], [], 0
        if len(x) > 2 * CHUNK:
            a, first = np.frombuffer(x, dtype=np.uint8), 0
            while first < len(x):
                last = first + CHUNK
                while last < len(x):  # look for white space, a chunk at a time
                    white = np.flatnonzero(SPACE[a[last : last + CHUNK]])
                    if len(white):
                        last += int(white[0])
                        break
                    last += CHUNK
                yield [k], [x[first:last]], first == 0
                first = last
            continue
        numbers.append(k)
        part.append(x)
        size += len(x) + 1
    if part:
        yield numbers, part, True


def encode(texts: list[bytes], path: str, end: int | None) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, ``end`` appended if given."""
    whole, runs, _ = _tokenizer(path)
    tail = b"" if end is None else np.array([end], dtype="<u4").tobytes()
    if runs is None:
        codes = whole.encode_batch_fast([x.decode("utf-8", "replace") for x in texts], add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() + tail for x in codes]
    table = _kept.setdefault(path, _Table())
    out: list[bytes] = [b""] * len(texts)
    for numbers, part, _ in _parts(texts):
        ids, starts, lengths = _encode_chunk(b"\n".join(part), path, table)
        raw = ids.astype("<u4", copy=False).tobytes()
        firsts = np.cumsum([0] + [len(x) + 1 for x in part])
        after = np.concatenate([[0], np.cumsum(lengths)])[np.searchsorted(starts, firsts)] * 4
        for k, a, b in zip(numbers, after[:-1].tolist(), after[1:].tolist(), strict=True):
            out[k] = out[k] + raw[a:b] if out[k] else raw[a:b]
    return [x + tail for x in out]
