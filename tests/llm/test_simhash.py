import random

import numpy as np
import xxhash

from plexus.llm import simhash


def slow_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, bits=4):
    fp = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: (f"{fp[i]:016x}", least[find(i)]) for i, (k, _) in enumerate(rows)}


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


def test_groups_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(simhash.near_groups(docs)) == slow_groups(rows)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert result(simhash.near_groups(odd_docs)) == slow_groups(rows)
    assert simhash.near_groups(no_docs).count() == 0
    twice = odd_docs.unionAll(odd_docs)
    assert simhash.near_groups(twice).count() == 2 * len(rows)
    null_key = spark.createDataFrame([(None, "p q r s t"), (4, "u v w x y")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_groups(null_key).collect()} == {(None, None), (4, 4)}


def test_trees_lose_no_pair(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    flips = np.zeros(3000, np.uint64)
    for _ in range(4):
        flips ^= np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips]))
    for depth in (0, 5, 12):
        met = set()
        for tree in range(3):
            who, node = simhash.route(fps, tree, depth)
            for leaf in np.unique(node) if depth else [1]:
                a, b = simhash.leaf_links(fps[who[node == leaf]])
                met |= set(zip(a.tolist(), b.tolist()))
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in met:
            root[find(a)] = find(b)
        for x, y in zip(base.tolist(), (base ^ flips).tolist()):
            assert find(x) == find(y)


def test_large_leaf_is_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_CAP", 50)
    random.seed(3)
    start = random.getrandbits(64)
    fps = {start}
    while len(fps) < 300:
        fps.add(random.choice(sorted(fps)) ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    from plexus.llm.common import connected_components

    labels = connected_components(simhash.links(df, len(fps))).collect()
    assert len({r.root for r in labels}) == 1
    assert len(labels) == len(fps) - 1
