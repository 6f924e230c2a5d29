"""Fingerprints by the contract's words, and the trie join against all pairs."""

import random

import numpy as np
import xxhash

from fluxmere.llm.components import components
from fluxmere.llm.simhash import Order, _edges, fingerprint, hamming_components, keep_one, linked, orders, simhash_components


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, " \n\t", "One", "one two", "One TWO three four", "one two three four five", "É é\x85x y\xa0z w v", "a b c d " * 40, "ÀB cd EF gh ij"]


def test_fingerprints():
    assert [fingerprint(t) for t in TEXTS] == [slow_fingerprint(t) for t in TEXTS]


def near(rng, n):
    base = rng.integers(0, 2**64, n, dtype=np.uint64)
    out = [base]
    for _ in range(4):
        flips = np.zeros(n, np.uint64)
        for _ in range(int(rng.integers(1, 4))):
            flips ^= np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
        out.append(base ^ flips)
    return np.unique(np.concatenate(out))


def agree(x, y, depth):
    return (int(x) ^ int(y)) >> (64 - depth) == 0


def test_trie_like_all_pairs():
    rng = np.random.default_rng(2)
    for n, depth in ((0, 3), (1, 3), (2, 1), (60, 1), (60, 4)):
        a, b = near(rng, n), near(rng, n)
        b = np.unique(np.concatenate([b, a[: n // 2] ^ np.uint64(0b10111)]))
        for left, right in ((a, None), (a, np.setdiff1d(b, a))):
            every = left if right is None else np.concatenate((left, right))
            pairs = [(i, j) for i in range(len(left)) for j in range(i + 1 if right is None else len(left), len(every)) if int(every[i] ^ every[j]).bit_count() <= 4 and agree(every[i], every[j], depth)]
            want = union_find(range(len(every)), pairs)
            assert linked(left, right, 4, depth).tolist() == [want[i] for i in range(len(every))]


def test_orders():
    values = np.random.default_rng(3).integers(0, 2**64, 50, dtype=np.uint64)
    for n, count in ((1000, 5), (10**6, 15), (10**9, 35), (10**15, 70)):
        made = orders(n, 4)
        assert len(made) == count
        for o in made:
            assert np.array_equal(o.restored(o.permuted(values)), values)
        # Whichever four bits differ, some order has them all behind the chosen ones.
        for bits in ((0, 13, 26, 39), (0, 1, 2, 3), (10, 30, 50, 63)):
            flip = np.array([sum(1 << (63 - x) for x in bits)], np.uint64)
            assert any(int(o.permuted(flip)[0]) >> (64 - o.depth) == 0 for o in made)
    assert Order(5, (0,)).depth == 12


def links_of(values):
    """(u, v) of the forests of all orders, each over all values as one block."""
    out = []
    for o in orders(len(values), 4):
        leaves = np.sort(o.permuted(values))
        u, v = _edges(leaves, linked(leaves, None, 4, o.depth), o)
        out += zip(u.view(np.uint64).tolist(), v.view(np.uint64).tolist(), strict=True)
    return out


def test_many_like_all_pairs_of_a_sample():
    """200,000 fingerprints, among them copies a few bits apart and a crowd of 3,000 around one; a sample meets all of them."""
    rng = np.random.default_rng(4)
    crowd = np.full(3000, rng.integers(0, 2**64, dtype=np.uint64))
    for _ in range(3):
        crowd ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    values = np.unique(np.concatenate([rng.integers(0, 2**64, 172_000, dtype=np.uint64), near(rng, 5000), crowd]))
    assert len(values) > 195_000
    root = union_find(values.tolist(), links_of(values))
    sample = np.concatenate([rng.choice(values, 150), crowd[:30]])
    for x in sample:
        for y in values[np.bitwise_count(values ^ x) <= 4].tolist():
            assert root[y] == root[int(x)]
    # Nothing else is joined: links are within the budget, or join leaves that others connect.
    base = union_find(range(len(sample)), [(i, j) for i in range(len(sample)) for j in range(i) if int(sample[i] ^ sample[j]).bit_count() <= 4])
    assert len({root[int(x)] for x in sample}) <= len(set(base.values()))


def test_blocks_that_meet(spark):
    """Blocks so small that prefixes span many of them."""
    rng = np.random.default_rng(5)
    values = np.unique(np.concatenate([near(rng, 40), np.uint64(7 << 60) | rng.integers(0, 1 << 14, 150, dtype=np.uint64)]))
    found = {r.id: r.component for r in hamming_components(spark.createDataFrame([(int(x),) for x in values.view(np.int64)], "fp bigint"), block=16).collect()}
    ids = values.view(np.int64).tolist()
    want = union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    assert {i: found.get(i, i) for i in ids} == want


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 200)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(7, 7)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = union_find({x for p in links for x in p if p[0] != p[1]}, links)
    assert found == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def rows():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choices(words, k=300) for _ in range(25)]
    out = []
    for k in range(200):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(300)] = rng.choice(words)
        out.append((k, " ".join(own)))
    return out + [(k, t) for k, t in enumerate(TEXTS, 300)] + [(None, TEXTS[5]), (305, TEXTS[5]), (305, TEXTS[5])]


def test_query_like_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "z") for r in data], "doc_id bigint, text string, fp int, component string").repartition(7)
    found = simhash_components(df).collect()
    prints = sorted({slow_fingerprint(t) for _, t in data})
    root = union_find(prints, [(a, b) for k, a in enumerate(prints) for b in prints[k + 1 :] if (a ^ b).bit_count() <= 4])
    least = {}
    for i, t in data:
        if i is not None:
            c = root[slow_fingerprint(t)]
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, f"{slow_fingerprint(t):016x}", least[root[slow_fingerprint(t)]]) for i, t in data), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == want
    kept = keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())
    assert keep_one(df).columns == df.columns


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash_components(empty).count() == 0 and keep_one(empty).count() == 0
