import hashlib
import random

import numpy as np

from plexus.llm import inducedsort, suffixdedup


def brute(rows, w=100):
    seen, out = set(), {}
    for i, t in rows:
        x = (t or "").encode()
        flag = bytearray(len(x))
        for j in range(len(x) - w + 1):
            s = x[j : j + w]
            if s in seen:
                flag[j : j + w] = b"\1" * w
            else:
                seen.add(s)
        kept = bytes(b for b, f in zip(x, flag) if not f)
        spans = sum(1 for j in range(len(x)) if flag[j] and (j == 0 or not flag[j - 1]))
        out[i] = (len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r[0]: tuple(r)[1:5] for r in df.drop("kept").collect()}


def test_removal_matches_brute_force(spark, sf, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.text) + [(r.doc_id, None) for r in docs.collect() if not r.text]
        assert result(suffixdedup.remove_repeats(docs)) == brute(rows)
    assert suffixdedup.remove_repeats(no_docs).count() == 0


def test_periodic_and_multibyte_texts(spark):
    random.seed(6)
    base = ["a" * 500, "ab" * 300, "".join(random.choice("xyz é") for _ in range(900)), None, "", "q" * 99, "q" * 100, "q" * 101]
    rows = []
    for i in range(60):
        b, c = random.choice(base), random.choice(base) or ""
        rows.append((i, None if b is None else b[random.randint(0, 50) :] + c[: random.randint(0, len(c))]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(suffixdedup.remove_repeats(df)) == brute(rows)


def test_equal_and_null_keys(spark):
    dup = spark.createDataFrame([(1, "z" * 300), (1, "z" * 300), (None, "y" * 200), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in suffixdedup.remove_repeats(dup).collect())
    assert got == [(-1, 0, 0), (-1, 200, 199), (1, 300, 299), (1, 300, 300)]


def test_suffix_order():
    random.seed(2)
    rng = np.random.default_rng(3)
    for _ in range(200):
        n, a = random.randint(1, 60), random.choice([1, 2, 4, 200])
        x = np.append(rng.integers(1, a + 1, n), 0)
        assert inducedsort.suffix_array(x, 1 << 20).tolist() == sorted(range(n + 1), key=lambda i: x[i:].tolist())


def test_spilled_queues_give_the_same(tmp_path):
    rng = np.random.default_rng(8)
    data = np.tile(rng.integers(97, 101, 700).astype(np.uint8), 9)
    at, rank = np.array([0, 3000, len(data)]), np.arange(len(data))
    plain = np.sort(inducedsort.repeated_windows(data, at, rank, 100))
    spilled = np.sort(inducedsort.repeated_windows(data, at, rank, 100, str(tmp_path / "q"), 2000))
    assert np.array_equal(plain, spilled) and len(plain)
    assert not list((tmp_path / "q").iterdir())


def test_group_beyond_a_shard(spark, monkeypatch):
    """A phrase in many contexts is one minimizer's group, larger than a shard."""
    random.seed(9)
    limit = 4000
    plain = inducedsort.repeated_windows

    def bounded(data, *more):
        assert len(data) <= 2 * limit, f"a shard of {len(data)} bytes"
        return plain(data, *more)

    monkeypatch.setattr(suffixdedup, "SHARD", limit)
    monkeypatch.setattr(suffixdedup, "repeated_windows", bounded)
    phrase = "".join(random.choice("abcdefgh") for _ in range(90))
    noise = lambda n: "".join(random.choice("klmnopqrst ") for _ in range(n))
    rows = [(i, noise(60) + phrase + random.choice(["", "x" * 7]) + noise(60)) for i in range(150)]
    rows += [(200 + i, rows[3 * i][1][random.randint(0, 40) :] + noise(30)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(suffixdedup.remove_repeats(df)) == brute(rows)
