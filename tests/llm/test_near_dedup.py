import random
import re
from collections import defaultdict

import numpy as np
import pytest

from plumeline.llm import near_dedup
from plumeline.llm.components import components
from plumeline.llm.near_dedup import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string, component_id string, n long"


def shingles(text, width):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent=80):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def group(rng, base, n, most):
    out = []
    for _ in range(n):
        rate = rng.random() * most
        out.append(" ".join(w if rng.random() > rate else f"x{rng.randrange(10**6)}" for w in base))
    return out


def test_components_match_brute_force_on_large_near_copy_groups(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size, most in ((140, 0.14), (60, 0.25), (3, 0.05)):
        texts += group(rng, rng.choices(vocabulary, k=120), size, most)
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(3, 80))) for _ in range(60)]
    texts += texts[:10]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    expected = brute(rows, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width=2).collect()}
    assert {k: (v, expected[k]) for k, v in got.items() if v != expected[k]} == {}
    sizes = defaultdict(int)
    for _, c in expected.values():
        sizes[c] += 1
    assert max(sizes.values()) > 60 and sum(v == 1 for v in sizes.values()) > 40


@pytest.mark.parametrize("width", [2, 5])
def test_edges(spark, width):
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, " \t\n", "c", 3), (4, "one", "d", 4), (5, "ONE", "e", 5), (None, "one", "f", 6), (7, "two words", "g", 7), (7, "two words", "g", 7), (9, "a " * 30000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(df, width).collect())
    assert got == [(0, 1, 4, False), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (7, 1, 7, True), (7, 1, 7, True), (9, 1, 9, True)]
    kept = drop_near_duplicates(df, width)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 7, 9]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).collect() == []
    assert drop_near_duplicates(df).collect() == []


def brute_components(sets, percent=80):
    """Ids of the least member of each set's component, by all pairs at once."""
    names = {x: i for i, x in enumerate(sorted({x for s in sets for x in s}))}
    held = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        held[i, [names[x] for x in s]] = 1
    shared, n = held @ held.T, held.sum(axis=1)
    linked = (100 * shared >= percent * (n[:, None] + n[None, :] - shared)) & (n > 0)[:, None]
    least = np.arange(len(sets))
    while True:
        lower = np.array([least[linked[i]].min() if linked[i].any() else least[i] for i in range(len(sets))])
        if (lower == least).all():
            return least
        least = lower


def test_large_group_just_below_the_threshold(spark):
    """Members differ from a base by rare words, by words that many share, and in length; families among them are linked, most are not."""
    rng = random.Random(12)
    base = [f"b{i}" for i in range(150)]

    def changed(words, share):
        out = []
        for w in words:
            if rng.random() >= share:
                out.append(w)
            elif (kind := rng.randrange(4)) == 0:
                out.append(f"r{rng.randrange(10**6)}")
            elif kind == 1:
                out.append(f"c{rng.randrange(12)}")
            elif kind == 2:
                out += [w, f"i{rng.randrange(200)}"]
        return out

    members = [changed(base, rng.choice((0.03, 0.06, 0.08, 0.09, 0.1, 0.11, 0.13, 0.2))) for _ in range(1000)]
    members += [changed(rng.choice(members[:20]), 0.03) for _ in range(200)]
    passage = [f"p{i}" for i in range(40)]
    members += [[f"q{rng.randrange(300)}" for _ in range(30)] + passage + [f"q{rng.randrange(300)}" for _ in range(30)] for _ in range(150)]
    rng.shuffle(members)
    texts = [" ".join(m) for m in members]
    expected = brute_components([shingles(t, 2) for t in texts])
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=2).collect()}
    assert {i: (got[i], int(c)) for i, c in enumerate(expected) if got[i] != c} == {}
    sizes = sorted(np.bincount(expected))
    assert sizes[-1] > 300 and (expected == np.arange(len(texts))).sum() > 300


def test_long_texts_in_parts(monkeypatch):
    rng = random.Random(3)
    for width in (2, 5):
        for text in (" ".join(f"w{rng.randrange(40)}" for _ in range(900)), "a" * 1000, "a" * 1000 + " b", " " * 900, "x " * 700):
            raw = np.frombuffer(text.encode(), np.uint8)
            whole = near_dedup.shingle_sets(raw, np.array([0, len(raw)]), width)[0]
            with monkeypatch.context() as m:
                m.setattr(near_dedup, "CHUNK_BYTES", 300)
                assert np.array_equal(near_dedup.shingle_sets(raw, np.array([0, len(raw)]), width)[0], whole)


def test_components_match_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (None, 3), (7, None)] + [(500, i) for i in range(501, 700)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(a, b, "x") for a, b in links], "u long, v long, m string")
    got = [(r.node, r.component) for r in components(df).collect()]
    assert dict(got) == {x: find(x) for x in parent if find(x) != x} and len(got) == len(set(got))
    assert components(df.limit(0)).collect() == []


def test_clashing_names(spark):
    rows = [(1, "one two three", "a", 1, 2), (2, "one two three", "b", 1, 2), (None, "x", "c", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, maybe_in string, filter_row int, asked int").withColumnRenamed("asked", "row")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1]
