"""The greedy cover that picks a lexicon."""

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm.toxicity import _cover


def plain(sets, least):
    left, out = [set(s) for s in sets], []
    while True:
        counts = {}
        for s in left:
            for i in s:
                counts[i] = counts.get(i, 0) + 1
        best = max(counts, key=lambda i: (counts[i], i), default=None)
        if best is None or counts[best] < least:
            return out
        out.append(best)
        left = [s for s in left if best not in s]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 8), max_size=5), max_size=12), st.integers(1, 3))
def test_cover(sets, least):
    assert _cover([sorted(s) for s in sets], lambda i: i, least) == plain(sets, least)
