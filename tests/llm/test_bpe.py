import hashlib
import struct

from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from prismark.llm import bpe


def by_library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_against_the_library(word_bpe):
    own, theirs = bpe.WordBpe(word_bpe), by_library(word_bpe)
    for t in [x or "" for x in ODD]:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_any_text(word_bpe):
    own, theirs = bpe.WordBpe(word_bpe), by_library(word_bpe)

    @settings(max_examples=400, deadline=None)
    @given(st.text(max_size=40))
    def same(t):
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == theirs.decode(ids, skip_special_tokens=False)

    same()


def test_stale_entries(word_bpe):
    """Merges that overlap: each round the lowest rank, leftmost first, by plain search."""
    own = bpe.WordBpe(word_bpe)

    def plain(ids):
        while True:
            ranks = [(own.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in own.merges]
            if not ranks:
                return ids
            i = min(ranks)[1]
            ids = [*ids[:i], own.merges[ids[i], ids[i + 1]][1], *ids[i + 2 :]]

    for w in ("aaaaaaaa", "mississippi", "thththth", "ererererer", "x", "antidisestablishmentarianism"):
        symbols = [own.vocab[c] for c in w[:-1]] + [own.vocab[w[-1] + own.end]]
        assert own.merge(symbols) == plain(symbols)


def test_query(odd, word_bpe):
    theirs = by_library(word_bpe)
    got = bpe.digests(odd, word_bpe).collect()
    assert len(got) == len(ODD) + 2
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(by_id[i])[1:] == want
    assert by_id[4].ids_sha256 == by_id[5].ids_sha256
    full = {r.doc_id: r for r in bpe.encoded(odd, word_bpe).collect()}
    assert hashlib.sha256(bytes(full[8].ids)).hexdigest() == by_id[8].ids_sha256 and hashlib.sha256(full[8].decoded.encode()).hexdigest() == by_id[8].decoded_sha256
    assert bpe.digests(odd.limit(0), word_bpe).count() == 0


def test_letters_composed_or_lowered_beyond_the_narrow_ones(word_bpe):
    """NFC and lower case can make letters that the narrow split doesn't know from characters that it does."""
    own, theirs = bpe.WordBpe(word_bpe), by_library(word_bpe)
    for t in ("'m\u0301a", "y\u0300\u00fb\u00ea", "\u00b2M\u0301", "x\u023ay", "\u023e's", "a\u0301b"):
        assert own.encode(t) == theirs.encode(t, add_special_tokens=False).ids


def test_split_by_arrays(word_bpe):
    """Texts below U+0100 are split as the pattern does; contractions and others are left to it."""
    own, theirs = bpe.WordBpe(word_bpe), by_library(word_bpe)

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.one_of(st.characters(max_codepoint=255), st.sampled_from(" '.sS19\x1c\x85\xa0")), max_size=30))
    def same(t):
        words = own.narrow(t)
        assert words is None or words == own.split.findall(t.lower())
        got = own.plain(t)
        assert own.merged(got) == [i for w in got for i in own.word(w)] == theirs.encode(t, add_special_tokens=False).ids

    same()
    assert own.narrow("it's") is None and own.narrow("'x 12") == ["'", "x", "1", "2"] and own.narrow("") == own.narrow(" \n") == []
