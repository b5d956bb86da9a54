"""The edit join's parts against plain edit distance."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import line_dedup

SHORT = st.text(alphabet=st.sampled_from("abé"), min_size=1, max_size=14)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=2000)
@given(a=SHORT, b=SHORT, edits=st.integers(0, 4))
def test_within(a, b, edits):
    assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits)


@given(a=st.text(min_size=100, max_size=300), edits=st.integers(1, 3), data=st.data())
def test_within_long(a, edits, data):
    b = a
    for _ in range(data.draw(st.integers(0, 5))):
        at = data.draw(st.integers(0, len(b)))
        b = b[:at] + data.draw(st.sampled_from(["", "x"])) + b[at + data.draw(st.integers(0, 1)) :]
    assert line_dedup.within(a, b, edits) == (distance(a, b) <= edits)


@settings(max_examples=1500)
@given(a=st.text(alphabet=st.sampled_from("abé"), min_size=10, max_size=34), edits=st.integers(1, 3), data=st.data())
def test_near_lines_share_a_key(a, edits, data):
    b = a
    for _ in range(edits):
        at = data.draw(st.integers(0, len(b)))
        b = b[:at] + data.draw(st.sampled_from(["", "a", "é"])) + b[at + data.draw(st.integers(0, 1)) :]
    short, long = sorted((a, b), key=len)
    if distance(a, b) > line_dedup.tolerance(len(short), edits):
        return
    found, counts = line_dedup.keys([short, long], [line_dedup.whole(len(x), edits) for x in (short, long)])
    one, two = (x.tolist() for x in np.split(found, counts[:1]))
    assert {x for x in one if x & 1} & {x | 1 for x in two}
    for x, own in ((short, one), (long, two)):
        assert sum(k & 1 for k in own) == line_dedup.tolerance(len(x), edits) + 1


def test_bags_differ_by_at_most_two_for_each_edit():
    x, y = line_dedup.bags(["abcé", "abxéy"])
    assert abs(x - y).sum() == 3
