import random
import tracemalloc

import pytest

from corpusmill.llm import decontaminate
from corpusmill.llm.common import alnum_words


def plain(items, window):
    """Windows as tuples of words, with the items that have them."""
    found = {}
    for name, raw in items:
        words = alnum_words(raw)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[k : k + window]), set()).add(name)
    return found


@pytest.mark.parametrize("window", [1, 2, 3, 7, 10])
def test_windows_are_those_of_a_plain_count(window):
    rng = random.Random(window)
    items = [(str(i % 50), " ".join(rng.choice("abc") for _ in range(rng.randrange(25))).encode()) for i in range(120)] + [(None, b"a b c"), ("n", None), ("e", b"")]
    tests = decontaminate.TestWindows(items, window)
    word = {i: w for w, i in tests.symbol.items()}
    got = {tuple(word[c] for c in tests.codes[e - n : e].tolist()): set(tests.items_of(k)) for k, (e, n) in enumerate(zip(tests.ends.tolist(), tests.lengths.tolist()))}
    assert len(got) == len(tests.lengths)
    assert got == {w: names - {None} for w, names in plain(items, window).items()}


@pytest.mark.parametrize("items", [[], [("a", None)], [("a", b" . ")]])
def test_no_windows(items):
    tests = decontaminate.TestWindows(items, 10)
    assert tests.shortest == 0 and not len(tests.lengths)
    assert decontaminate.find_spans([b"some words", None], tests) == [(2, [], set()), (0, [], set())]


def test_memory_of_a_full_pass():
    rng = random.Random(1)
    words = [f"w{i:05d}" for i in range(50_000)]
    items, size = [], 0
    while size < decontaminate.PASS_BYTES:
        raw = " ".join(rng.choices(words, k=2000)).encode()
        items.append((str(len(items)), raw))
        size += len(raw)
    tracemalloc.start()
    try:
        tests = decontaminate.TestWindows(items, 10)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(tests.lengths) > 2_000_000 and peak < 300 << 20, peak
