"""Properties of the plain functions under the operators, on generated inputs."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheet.llm import html_text, packing, repeats, repetition, simhash

few = settings(max_examples=60, deadline=None)


@few
@given(st.lists(st.text("ab", min_size=0, max_size=60), min_size=1, max_size=6), st.booleans())
def test_repeated_windows(texts, earlier):
    length = 4
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in raw])))[:-1]
    windows = np.array([s + i for s, t in zip(starts, raw, strict=True) for i in range(len(t) - length + 1)], np.int64)
    if not len(windows):
        return
    got = repeats.repeated_windows(data, windows, windows, length, earlier)
    strings = [data[w : w + length].tobytes() for w in windows]
    count, seen, want = Counter(strings), set(), []
    for s in strings:
        want.append(s in seen if earlier else count[s] > 1)
        seen.add(s)
    assert got.tolist() == want


@few
@given(st.binary(min_size=0, max_size=400))
def test_each_window_has_one_anchor(data):
    _, place, first, last = repeats.anchors(data, 20, 8)
    held = [w for a, b in zip(first, last, strict=True) for w in range(a, b + 1)]
    assert held == list(range(max(0, len(data) - 19)))
    assert all(a <= b and a >= p - 12 and b <= p for p, a, b in zip(place, first, last, strict=True)) if len(place) else True


@few
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=12), st.integers(1, 9), st.sampled_from(["residual_norm", "dot_product"]))
def test_packing_places_every_piece_once(histogram, documents, rule):
    limits = packing.Limits(tokens=50, documents=documents, rule=rule)
    plan = packing.best_fit(histogram, limits)
    held: dict[int, list] = {}
    for length, runs in plan.runs.items():
        ends = [r[0] for r in runs[1:]] + [histogram[length]]
        for (rank, first, offset), end in zip(runs, ends, strict=True):
            for k in range(end - rank):
                held.setdefault(first + k, []).append((offset, length))
    assert sum(map(len, held.values())) == sum(histogram.values()) and len(held) == plan.sequences
    for own in held.values():
        own.sort()
        assert len(own) <= documents and sum(n for _, n in own) <= 50
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()


@few
@given(st.lists(st.sampled_from(["a", "b", "c", "\n", "  "]), max_size=60))
def test_repeat_words(words):
    text = " ".join(words).encode()
    own = text.split()
    threes = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    want = {j for i in range(len(own) - 2) if threes[tuple(own[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert repetition.measure(text, repetition.Rules())[4] == len(want)


@few
@given(st.sets(st.integers(0, 2**12 - 1), min_size=1, max_size=80), st.integers(0, 3))
def test_trees_find_all_components(values, radius):
    ordered = sorted(values)
    tree = simhash.BKTree(radius)
    for v in ordered:
        tree.add(v)
    up = list(range(len(ordered)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(ordered)):
        for b in range(a):
            if (ordered[a] ^ ordered[b]).bit_count() <= radius:
                up[find(a)] = find(b)
    pairs = [(a, b) for a in range(len(ordered)) for b in range(a)]
    assert all((find(a) == find(b)) == (tree.find(a) == tree.find(b)) for a, b in pairs)


MARKUP = st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "text ", "&amp;", "<", ">", '"', "<article>", "</article>", "<table><tr><td>", "<!--", "-->", "<script>", "</script>", "<br/>"]), max_size=40)


@few
@given(MARKUP)
def test_pages_never_fail(parts):
    page = html_text.read_page("".join(parts))
    assert len(page.blocks) == len(page.places) and all(b == " ".join(b.split()) and b for b in page.blocks)
    assert all(0 <= a < b <= len(page.blocks) for _, a, b in page.subtrees)
