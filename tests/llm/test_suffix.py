import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from entiquery.llm import suffix

TEXTS = st.one_of(
    st.binary(max_size=80),
    st.text("ab", max_size=120).map(str.encode),
    st.tuples(st.binary(min_size=1, max_size=6), st.integers(1, 30)).map(lambda x: x[0] * x[1]),
)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_suffix_array(raw):
    text = np.frombuffer(raw, np.uint8)
    order = suffix.suffix_array(text)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    up = [i + 1 < len(raw) and raw[i:] < raw[i + 1 :] for i in range(len(raw))]
    assert suffix.rising(text).tolist() == up

    def common(a, b):
        n = 0
        while n < 20 and max(a, b) + n < len(raw) and raw[a + n] == raw[b + n]:
            n += 1
        return n

    got = suffix.common_prefixes(text, order, 20).tolist()
    assert got == [0] * bool(raw) + [common(a, b) for a, b in zip(order, order[1:])]


@given(TEXTS, st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_depth(raw, depth):
    order = suffix.suffix_array(np.frombuffer(raw, np.uint8), depth)
    cut = [raw[i : i + depth] for i in order]
    assert cut == sorted(cut) and sorted(order.tolist()) == list(range(len(raw)))
