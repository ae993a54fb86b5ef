"""The pipeline's near-duplicates against brute-force Jaccard."""

import random

import corpus_pipeline
from plexus.llm import jaccard, simhash

D = "/root/testdata/sf0.001"


def kept(rows):
    """Keys of the smallest row of each component at a five-word Jaccard of 0.8 or more."""
    sets, root = {}, {}
    for k, t in rows:
        w = (t or "").lower().encode().split()
        sets[k] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
        root[k] = k

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k for k in order if top(k) == k}


def stage(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(0 as long) as n_chars")
    return {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs.repartition(3), D).collect()}


def test_edited_copies(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, phrase = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "a b c d e"), (5, "a b c d e f")], [random.choice(vocabulary) for _ in range(40)]
    for _ in range(25):
        base = [random.choice(vocabulary) for _ in range(random.randint(5, 200))] + phrase
        for _ in range(6):
            text = list(base)
            for _ in range(random.randint(0, 1 + len(base) // 40)):
                text[random.randrange(len(text))] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    want = kept(rows)
    assert 30 < len(want) < len(rows) - 30
    assert stage(spark, rows) == want


def test_smallest_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    want = kept(rows)
    assert 177 not in want  # differs from an earlier row in more than 4 bits of 64
    assert stage(spark, rows) == want


def test_common_passages_and_hot_groups(spark, monkeypatch):
    """Shingles beyond HOT texts, groups beyond a chunk, and texts that only the second prefixes join."""
    monkeypatch.setattr(jaccard, "HOT", 6)
    monkeypatch.setattr(jaccard, "HOT_HERE", 4)
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    random.seed(11)
    word = lambda: f"w{random.randrange(100_000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(40):  # a passage that many texts hold, each otherwise different
        rows.append((len(rows), " ".join([word() for _ in range(50)] + passage + [word() for _ in range(20)])))
    base = [word() for _ in range(80)]
    for _ in range(40):  # a chain of edits, whose ends are no near copies of each other
        base = list(base)
        base[random.randrange(80)] = word()
        rows.append((len(rows), " ".join(base)))
    for k in (3, 17, 25):  # near copies of texts with the passage
        text = rows[k][1].split()
        text[5] = "edited"
        rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, " ".join(passage)) for i in range(12)] + [(200, " ".join(passage[:55] + ["end"]))]
    want = kept(rows)
    assert len(want) < len(rows) - 40
    assert stage(spark, rows) == want


def test_most_copies_are_linked_by_fingerprints(spark):
    """What the trees contribute before the rest: single edits of long texts."""
    random.seed(5)
    rows = []
    for _ in range(30):
        base = [f"v{random.randrange(5000)}" for _ in range(400)]
        rows.append(base)
        rows.append(base[:200] + ["x"] + base[201:])
    near = sum((simhash.fingerprint(" ".join(a).encode(), 5) ^ simhash.fingerprint(" ".join(b).encode(), 5)).bit_count() <= simhash.MAX_BITS for a, b in zip(rows[::2], rows[1::2], strict=True))
    assert near >= 20
