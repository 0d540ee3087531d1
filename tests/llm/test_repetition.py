import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import frame, with_extra
from tomeforge.llm import repetition as R


def brute(raw, least):
    """(positions covered, longest repeat) over all pairs of starts."""
    n, covered, longest = len(raw), set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and raw[i + k] == raw[j + k]:
                    k += 1
                best = max(best, k)
        if best >= least:
            covered.update(range(i, i + best))
            longest = max(longest, best)
    return len(covered), longest


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=70) | st.text("abcé\0", max_size=60), st.sampled_from([8, 11]))
def test_against_all_pairs(text, least):
    raw = text.encode()
    start, length = R.repeats(raw, least)
    assert (R.covered(start, length), int(length.max()) if len(length) else 0) == brute(raw, least)


def test_suffix_array_is_sorted():
    rng = random.Random(2)
    raw = bytes(rng.choice(b"ab") for _ in range(500)) * 3
    order, eight = R.suffix_array(raw)
    lcp = R.common_prefixes(raw, order, eight)[order]
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    wanted = [0] + [common(raw[a:], raw[b:]) for a, b in zip(order, order[1:])]
    assert [w if w >= 8 else 0 for w in wanted] == [v if v >= 8 else 0 for v in lcp.tolist()]


def test_common_prefixes_of_many_kinds():
    rng = random.Random(5)
    word = b"a", b"b"
    for _ in range(40):
        word = word[1], word[0] + word[1]
        if len(word[1]) > 3000:
            break
    texts = [b"x" * 3000, b"xy" * 1500, word[1], bytes(rng.choice(b"ab") for _ in range(2500)), b"".join(rng.choice([b"one ", b"two ", b"three "]) for _ in range(600)), b"q", b"", b"qq", "é\0ü".encode() * 200]
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    for raw in texts:
        order, eight = R.suffix_array(raw)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        found = R.common_prefixes(raw, order, eight)[order]
        wanted = ([0] + [common(raw[a:], raw[b:]) for a, b in zip(order, order[1:])])[: len(raw)]
        assert [v if v >= 8 else 0 for v in found.tolist()] == [w if w >= 8 else 0 for w in wanted]


def test_a_long_text_takes_memory_in_proportion():
    import tracemalloc

    raw = b"x" * 2_000_000
    tracemalloc.start()
    start, length = R.repeats(raw, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert length.max() == len(raw) - 1 and R.covered(start, length) == len(raw) and most < 60 * len(raw)


def test_limits_and_edges(spark):
    rng = random.Random(3)
    plain = " ".join(str(rng.random()) for _ in range(60))
    rows = [(1, plain, "en", "s", 0), (2, "all the same words again. " * 40, "en", "s", 0), (3, None, None, None, None), (4, "", "en", "s", 0), (None, plain, "en", "s", 0), (1, plain, "en", "s", 0), (5, "x" * 200_000, "en", "s", 0)]
    docs = with_extra(frame(spark, rows), "covered_fraction", "id", "odd`name")
    kept = R.keep_unrepetitive(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "1", "3", "4", "None"] and all(r["covered_fraction"] == 0 for r in kept)
    assert R.measure(docs).where("doc_id = 5").first()["longest_repeat"] == 199_999
    assert R.measure(docs.where("false")).count() == 0
    assert np.isclose(R.measure(docs).where("doc_id = 2").first()["covered_fraction"], 1.0)
