from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_duplicates as nd
from tessera.llm.shingles import pieces, shingle_sets


def brute(rows, sets):
    got = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(got[i] & got[j])
            if both and 100 * both >= 80 * len(got[i] | got[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(got[i]), least.get(find(i)) if got[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_components_match_brute_force(corpus, sets):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    got = sorted((tuple(r) for r in nd.near_duplicates(corpus).collect()), key=repr)
    assert got == brute(rows, sets)


def test_one_of_each_stays(corpus, sets):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    want = sorted({d for d, _, c in brute(rows, sets) if d == c and d is not None})
    kept = nd.keep_one_of_each(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 2


def test_empty(nothing):
    assert nd.near_duplicates(nothing).count() == 0
    assert nd.keep_one_of_each(nothing).count() == 0


def test_block_search_alone_finds_links_that_pivots_miss(spark, sets):
    """Every member links to a neighbour only, so most links aren't to a pivot."""
    base = [f"v{i}" for i in range(400)]
    docs = []
    for k in range(12):  # windows of 200 words shifted by 17: only neighbours link
        docs.append((k, " ".join(base[k * 17 : k * 17 + 200])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in nd.near_duplicates(df).collect()), key=repr)
    assert got == brute(docs, sets)


def test_tree_search_is_exact_within_its_bound():
    rng = np.random.default_rng(3)
    points = rng.poisson(3, (500, 32)).astype(np.int32)
    points[250:] = np.maximum(0, points[:250] + rng.integers(-1, 2, (250, 32)) * (rng.random((250, 32)) < 0.2))
    sizes = points.sum(1)
    tree = nd.CountTree(points, sizes)
    for i in range(0, 500, 7):
        want = {j for j in range(500) if nd.enough(int(np.minimum(points[i], points[j]).sum()), int(sizes[i]), int(sizes[j]))}
        assert set(tree.search(points[i], int(sizes[i])).tolist()) == want


def test_shingle_hashes_tell_sets_apart(sets):
    texts = ["a b c d e f", "A B c d e  f", "b a c d e f", "a b c", "abc", "a bc", "", None, "a b c d e f g", "é x", "e x"]
    got = []
    for _, data, offs in pieces(pa.array(texts)):
        s, at = shingle_sets(data, offs)
        got += [tuple(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    for i, a in enumerate(texts):
        assert len(got[i]) == len(sets(a))
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (sets(a) == sets(b))


@pytest.mark.parametrize("n", [64, 100, 300, 1000])
def test_keys_meet_at_the_threshold(n):
    """Pairs at exactly 0.8 share a key."""
    rng = np.random.default_rng(n)
    for _ in range(40):
        pool = np.unique(rng.integers(0, 2**64, 2 * n, dtype=np.uint64))
        rng.shuffle(pool)
        shared = -(-8 * n // 9)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
        k = [set(nd.group_keys(x, np.array([0, len(x)]))[0].tolist()) for x in (a, b)]
        assert k[0] & k[1]


def test_long_texts_are_hashed_in_parts():
    """Words, shingles and their hashes are those of the text in one piece."""
    from tessera.llm import shingles

    text = " ".join(f"w{i % 977}" for i in range(900_000)) + " " + "x" * 3_000_000 + "  y z"
    data = np.frombuffer(text.encode(), np.uint8)
    offs = np.array([0, len(data)])
    assert len(data) > 2 * shingles.PIECE
    got, first = shingles.word_hashes(data, offs)
    assert (got == shingles._word_hashes(data, offs)[0]).all() and first.tolist() == [0, 900_003]


def test_stock_phrase_makes_no_large_block(spark, sets):
    """Short texts that share a phrase meet by their own words."""
    phrase = " ".join(f"stock{i}" for i in range(14))
    docs = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} {phrase}") for i in range(600)]
    docs += [(1000 + i, f"a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} {phrase} z") for i in range(0, 600, 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    common = nd.common_shingles(df.select("text"))
    assert len(common) >= 10
    sizes = {}
    for kind in (None, common):
        for _, data, offs in pieces(pa.array([t for _, t in docs])):
            keys = nd.group_keys(*shingle_sets(data, offs), kind)[0]
            sizes[kind is None] = int(np.unique(keys, return_counts=True)[1].max())
    assert sizes[False] <= 4  # without the order some stock shingle is a key of all
    assert sorted((tuple(r) for r in nd.near_duplicates(df).collect()), key=repr) == brute(docs, sets)


@pytest.mark.parametrize("n", [1, 5, 23, 63])
def test_first_shingles_meet_whatever_the_order(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**64, 2 * n + 2, dtype=np.uint64))
        rng.shuffle(pool)
        common = np.sort(rng.choice(pool, n // 2, replace=False))
        shared = -(-8 * n // 9)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:shared], pool[n : 2 * n - shared]]))
        if nd.enough(len(np.intersect1d(a, b)), len(a), len(b)):
            k = [set(nd.group_keys(x, np.array([0, len(x)]), common)[0].tolist()) for x in (a, b)]
            assert k[0] & k[1]
