"""Properties that hold for any input."""

import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bm25, packing, sharding, warc

FAST = settings(max_examples=60, deadline=None)


@FAST
@given(st.integers(1, 10_000), st.integers(1, 64))
def test_pieces_cover_a_document(length, capacity):
    pieces = packing.cuts(length, capacity)
    assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:])) and sum(n for _, n in pieces) == length
    assert all(n == capacity for _, n in pieces[1:]) and 0 < pieces[0][1] <= capacity


@FAST
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 500), min_size=1))
def test_bins_use_the_histogram_up(histogram):
    left, number = dict(histogram), 0
    for b in packing.best_two_fit(histogram, 32):
        assert b.first == number and 0 < sum(n * c for n, c in b.pieces) <= 32
        number += b.repeats
        for n, c in b.pieces:
            left[n] -= c * b.repeats
    assert not any(left.values())
    assert number <= sum(histogram.values())


@FAST
@given(st.dictionaries(st.integers(0, 63), st.integers(1, 10_000)), st.integers(1, 8), st.integers(1, 9))
def test_edits_keep_every_slot_owned(load, shards, grown):
    first = sharding.SlotMap.initial(64, shards)
    even = first.rebalanced(load)
    again = even.rebalanced(load, max(shards, grown))
    for m in (even, again):
        assert len(m.owner) == 64 and all(0 <= s < m.shards for s in m.owner)
    assert even.rebalanced(load).moved == () and again.version == 2


@FAST
@given(st.lists(st.binary(max_size=200), max_size=8), st.integers(0, 9))
def test_members_come_back_from_pieces(payloads, level):
    contents = [warc.record("response", i, "http://x", p, "d", None) for i, p in enumerate(payloads)]
    raw = b"".join(warc.member(c, level) for c in contents)
    pieces = [warc.MAGIC + p for p in raw.split(warc.MAGIC)[1:]]
    orphans = []
    found = [c for m in warc.assembled(pieces, orphans) if (c := b"".join(m.content))]
    assert found == contents and not orphans and all(warc.member(c, level)[-1] == 0 for c in contents)
    assert [warc.parsed(c)["payload"] for c in found] == payloads and zlib.crc32(raw) == zlib.crc32(b"".join(pieces))


@FAST
@given(st.text())
def test_terms_hold_no_separators(text):
    for t in bm25.terms_of(text):
        assert t and t == t.lower() and not set(t) & set(b" \t\n\r\x0b\x0c.,!?;:'\"")
