import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from foliant.llm import packing, piece_counts, tokens, wavelet
from foliant.llm.tokens import encode, vocabulary

ODD = ["Foo's don't I'LL x_y é é Ä̈b ﬁ 12a3 ÿß İ Σς ok...!? a-b (c)​ 　 日本語", "", "  ", "\ttab\x0bvt \x1c fs \x85 nel", "a" * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def test_ids_are_the_librarys(docs, library):
    texts = ODD + [r["text"] for r in docs.limit(60).collect()]
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for t in texts]
    assert encode([t.encode() for t in texts], vocabulary(), 1) == want


def test_items_of_every_kind(library):
    texts = [
        "a", "A1b22'S don't 'sup !!'s a'", "É×÷ éÉ <|endoftext|>x a<|b|> x<|startoftext|>", "日本語 テスト のs 1.5 ½", "x y\x85z \x1c \x00 a\x00b\x7f",
        "ΑΣ Straße ẞ ÿŸ µ ª", "x" * 100 + " " + "!" * 100, "ab\ncd\x0bef\x0cg \r\n\t  h", "l'Été qu'il c'est 'll they'LL", "a < | b <| c", "\u0301a A\u030a e\u0301e",
    ]
    for text in texts:
        assert encode([text.encode()], vocabulary(), None) == [np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()], text


def test_long_texts_and_a_full_table(docs, library, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 700)
    monkeypatch.setattr(tokens, "KEPT", 300)
    texts = [r["text"] for r in docs.limit(40).collect()]
    long = "\n".join(texts) + " " + "y" * 5000 + " end"
    for text, ids in zip([long, "", "a"], encode([x.encode() for x in (long, "", "a")], vocabulary(), None), strict=True):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_table_grows():
    table, rng = tokens._Table(), np.random.default_rng(3)
    keys = np.unique(rng.integers(1, 1 << 63, 1_500_000).astype(np.uint64) << np.uint64(1))
    lengths = rng.integers(0, 4, len(keys))
    ids = rng.integers(0, 1000, lengths.sum()).astype(np.uint32)
    ends = np.cumsum(lengths)
    for a in range(0, len(keys), 400_000):
        b = min(len(keys), a + 400_000)
        table.add(keys[a:b], lengths[a:b], ids[ends[a] - lengths[a] : ends[b - 1]])
    some = rng.permutation(len(keys))[:50_000]
    got, n = table.ids_at(table.find(keys[some]))
    assert (n == lengths[some]).all() and (got == np.concatenate([ids[ends[k] - lengths[k] : ends[k]] for k in some])).all()
    assert (table.find(keys[:100] + np.uint64(1)) == -1).all()


def test_other_tokenizers_are_used_as_they_are(library):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    want = Tokenizer.from_file(path).encode("Two  words, don't", add_special_tokens=False).ids
    assert encode([b"Two  words, don't"], path, None) == [np.array(want, dtype="<u4").tobytes()]


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 50_000, 40_000).astype("u4")
    ids[100:900] = 7
    m = wavelet.WaveletMatrix(wavelet.build(ids, np.arange(3), np.array([1, 2, 39_997])))
    assert (m.decode() == ids).all()
    assert all(m.access(k) == ids[k] for k in range(0, 40_000, 997))
    assert m.count(7) == (ids == 7).sum() and m.count(7, 50, 300) == (ids[50:300] == 7).sum() and m.count(1 << 20) == 0
    places = np.flatnonzero(ids == 7)
    assert [m.select(7, k) for k in (0, 400, len(places) - 1)] == places[[0, 400, -1]].tolist()
    rng = np.random.default_rng(2)
    for most, n in ((1, 5), (2, 700), (3, 513), (300, 5000), (65_536, 33_000), (7, 1)):
        ids = rng.integers(0, most, n).astype("u4")
        m = wavelet.WaveletMatrix(wavelet.build(ids, np.arange(1), np.array([n])))
        assert (m.decode() == ids).all()
        for token in {0, most - 1, int(ids[0]), int(ids[-1])}:
            places = np.flatnonzero(ids == token)
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert m.count(token) == len(places) and m.count(token, a, b) == (ids[a:b] == token).sum()
            assert [m.select(token, k) for k in range(0, len(places), 1 + len(places) // 9)] == places[:: 1 + len(places) // 9].tolist()
            with pytest.raises(IndexError):
                m.select(token, len(places))
    empty = wavelet.WaveletMatrix(wavelet.build(np.zeros(0, "u4"), np.zeros(0, "i8"), np.zeros(0, "u4")))
    assert len(empty.decode()) == 0


def test_shards_round_trip(odd_docs, no_docs, library):
    rows = odd_docs
    table = wavelet.write_shards(rows, shard_tokens=50)
    got = wavelet.read_shards(table).orderBy("start").collect()
    held = sorted(((r["doc_id"], r["text"] or "") for r in rows.collect()), key=lambda x: (x[0] is not None, x[0]))
    start = 0
    for r, (doc_id, text) in zip(got, held, strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], dtype="<u4").tobytes()
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (doc_id, start, len(ids) // 4, ids)
        start += len(ids) // 4
    assert table.count() > 1
    assert wavelet.read_shards(wavelet.write_shards(no_docs)).count() == 0


def test_packing(odd_docs, no_docs, library):
    rows = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 1")
    got = packing.pack(rows, capacity=64).toPandas()
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for doc_id, part in got.groupby("doc_id"):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 0]
        part = part.sort_values("piece")
        assert part["start"].tolist() == list(range(0, len(ids), 64)) and part["length"].sum() == len(ids)
        for p in part.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes())
    check_sequences(got, 64)
    assert packing.pack(no_docs).count() == 0


def check_sequences(got, capacity):
    placed = got.sort_values(["sequence_id", "offset"])
    ends = placed["offset"] + placed["length"]
    first = placed["sequence_id"].ne(placed["sequence_id"].shift())
    assert (placed["offset"][first] == 0).all() and (ends <= capacity).all()
    assert (placed["offset"][~first] == ends.shift()[~first]).all()


def test_repeated_rows_and_rows_without_id_are_packed_each(odd_docs):
    got = packing.pack(odd_docs.where("doc_id = 1 OR doc_id IS NULL")).toPandas()
    assert len(got) == 3
    check_sequences(got, packing.CAPACITY)


def test_plan_fills_gaps_exactly():
    counts = np.zeros(11, dtype=np.int64)
    counts[[6, 2, 1, 5, 3]] = [2, 2, 4, 2, 0]
    plan = packing.plan_of(counts)
    used = np.zeros(11, dtype=np.int64)
    for pattern, times in plan:
        assert sum(pattern) <= 10
        for x in pattern:
            used[x] += times
    assert (used == counts).all() and sum(n for _, n in plan) == 3


def test_piece_counts_are_greedy():
    pieces = piece_counts.pieces_of(vocabulary())
    known = set(pieces) | {(b,) for b in range(256)}

    def greedy(word):
        s, k, n = (*word, piece_counts.END), 0, 0
        while s[k : k + 2] not in ((), (piece_counts.END,)):
            k = next(j for j in range(min(len(s), k + longest), k, -1) if s[k:j] in known)
            n += 1
        return n

    longest = max(map(len, known))
    rng = np.random.default_rng(0)
    words = [w.encode() for w in ("the", "theatre", "unbelievably", "a", "日本語", "éléphant", "x" * 70, "!!??", "they're")]
    words += [bytes(rng.choice(list(b"abcdefehinorst"), rng.integers(1, 14)).tolist()) for _ in range(500)]
    words += [bytes(rng.choice(list(b"abcdefehinorst\xe6\x97"), n).tolist()) for n in (255, 256, 257, 20_000)]
    assert piece_counts.automaton(vocabulary()).counts(words).tolist() == [greedy(w) for w in words]
    got = piece_counts.count_pieces([words[-1] + b" the " + words[-2], b"the"], vocabulary())
    assert got == [(3, greedy(words[-1]) + 1 + greedy(words[-2])), (1, 1)]


def test_piece_count_rows(odd_docs, no_docs):
    got = {r["doc_id"]: (r["n_words"], r["n_pieces"]) for r in piece_counts.piece_counts(odd_docs).collect()}
    assert got[2] == got[3] == got[4] == (0, 0) and got[6] == (1, 1) and got[5][0] == 80_000
    assert piece_counts.piece_counts(no_docs).count() == 0
