import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBé 日\t\n\x0b\x1c\x85.", max_size=30), min_size=1, max_size=6))
def test_words_are_the_patterns(texts):
    found = words.Words([t.encode() for t in texts], lower=True)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    assert found.counts.tolist() == [len(w) for w in want]
    flat = [w for x in want for w in x]
    assert [found.data[a:b] for a, b in zip(found.starts, found.ends, strict=True)] == flat
    h = found.hashes()
    assert len(set(h.tolist())) == len(set(flat))
    by_word = {}
    for w, x in zip(flat, h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x


def test_ngrams_depend_on_order_and_stay_in_their_text():
    found = words.Words([b"a b c", b"", b"b a"])
    h = found.hashes()
    assert words.starts_ngram(found.counts, 2).tolist() == [True, True, False, True, False]
    grams = words.ngram_hashes(h, 2)
    assert grams[0] != grams[3]
    assert len(words.ngram_hashes(h[:1], 2)) == 0


def test_chunks_cover_all_rows():
    texts = [b"x" * n for n in (5, 0, 50, 3, 3)]
    assert list(words.chunks(texts, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert np.array_equal(words.sums_by(np.array([2, 0, 1]), np.array([1.0, 2.0, 5.0])), [3, 0, 5])
