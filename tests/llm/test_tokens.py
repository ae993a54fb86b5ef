import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plexus.llm import packing, tokencount, tokenfile, tokens

EDGES = ["a  b", "a\n b\n\nc  ", "it's We'LL don't", "İstanbul ΑΣ ß", "a<|endoftext|> b", "½ ² 日本\x1cx", " lead", " ", "tail \n", "x y　z", ""]


@pytest.fixture(scope="module")
def texts(spark):
    random.seed(4)
    alphabet = "ab '\nsSéÉ ,.1½<|endoftext|>  \t日İΣ́"
    made = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(400)]
    return EDGES + made + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


def test_cached_encoder_equals_library(texts):
    encoder = tokens.WordEncoder(tokens.public_path("word_bpe_49k.json"))
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_two_tier_counts_equal_library(spark, texts):
    path = tokens.public_path("byte_bpe_50k.json")
    frequent = tokencount.frequent(spark.createDataFrame([(t,) for t in texts], "text string"))
    table = tokencount.frequent_lengths(frequent, path)
    for known in (table, {}):
        counter = tokens.TokenCounter(path, known)
        for t in texts:
            assert counter.count(t) == len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    assert max(table.values()) > 1


def test_first_tier_answers_most(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = tokens.public_path("byte_bpe_50k.json")
    table = tokencount.frequent_lengths(tokencount.frequent(docs), path)
    assert len(table) <= tokencount.FREQUENT and sum(n > 1 for n in table.values()) > 100
    pieces = [p for r in docs.collect() for p in tokens.TokenCounter.PIECES.findall(r.text or "")]
    met = Counter(pieces)
    assert sum(n for p, n in met.items() if p in table) > 0.8 * len(pieces)
    assert all(p in table for p, _ in met.most_common(300))


def test_long_texts(spark):
    """Texts of some megabytes, with special strings and separator controls in them."""
    words = ["word", "Größe", "x" * 70, "it's", "日本", "<|endoftext|>", "a\x1cb", "12,5"]
    random.seed(8)
    long = " ".join(random.choice(words) for _ in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, "z" * 200_000), (3, long[:1000])], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    byte = tokens.library(tokens.public_path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs).collect()} == {k: len(byte.encode(t, add_special_tokens=False).ids) for k, t in rows}
    ids = slow_ids(rows, 2)
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenfile.write_tokens(docs).read(spark).collect()} == {k: (len(x), crc(x)) for k, x in ids.items()}
    check_packing(packing.pack(docs).collect(), slow_ids(rows, 1), 2048)


def test_count_query(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in tokencount.count_tokens(odd_docs, limit=3).collect()}
    tk = tokens.library(tokens.public_path("byte_bpe_50k.json"))
    for r in odd_docs.collect():
        n = len(tk.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 3)
    assert tokencount.count_tokens(no_docs).count() == 0


def slow_ids(rows, end):
    tk = tokens.library(tokens.public_path("word_bpe_49k.json"))
    return {k: [*tk.encode(t or "", add_special_tokens=False).ids, end] for k, t in rows}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, sf, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        ids = slow_ids([(r.doc_id, r.text) for r in docs.collect()], 2)
        before, expected = 0, {}
        for k in sorted(ids):
            expected[k] = (before, len(ids[k]), crc(ids[k]))
            before += len(ids[k])
        files = tokenfile.write_tokens(docs)
        assert {r.doc_id: tuple(r)[1:] for r in files.read(spark).collect()} == expected
        dictionary = files.dictionary()
        file = f"{files.folder}/{files.shards[0][0]}"
        reader = tokenfile.ShardReader(file, dictionary)
        last = len(reader.keys) - 1
        assert reader.ids(last).tolist() == ids[int(reader.keys[last])]
        with pytest.raises(ValueError):
            tokenfile.ShardReader(file, dictionary + b"x")
        again = tokenfile.TokenFiles.open(files.folder)
        assert again.shards == files.shards and again.read(spark).count() == len(ids)
    assert tokenfile.write_tokens(no_docs).read(spark).count() == 0


def test_token_files_null_and_equal_keys(spark):
    docs = spark.createDataFrame([(5, "b"), (5, "b"), (None, "a"), (1, None)], "doc_id long, text string")
    got = sorted(tuple(r)[:3] for r in tokenfile.write_tokens(docs).read(spark).fillna(-1).collect())
    assert got == [(-1, 0, 2), (1, 2, 1), (5, 3, 2), (5, 5, 2)]


def check_packing(rows, ids, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == crc(ids[k][at : at + r.length])
            at += r.length
        assert at == len(ids[k])
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))
    return sum(r.length for r in rows) / (capacity * len(by_seq))


def test_packing(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = slow_ids([(r.doc_id, r.text) for r in docs.collect()], 1)
    assert check_packing(packing.pack(docs).collect(), ids, 2048) > 0.95
    check_packing(packing.pack(docs, capacity=100).collect(), ids, 100)
    check_packing(packing.pack(odd_docs).collect(), slow_ids([(r.doc_id, r.text) for r in odd_docs.collect()], 1), 2048)
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(odd_docs.unionAll(odd_docs)).count() == 2 * packing.pack(odd_docs).count()


def test_histogram_is_used_up():
    random.seed(5)
    for _ in range(300):
        capacity = random.choice([1, 7, 64, 2048])
        histogram = {random.randint(1, capacity): random.randint(0, 500) for _ in range(random.randint(0, 30))}
        used = {}
        for pattern, packs in packing.shortest_pack_first(histogram, capacity):
            assert packs > 0 and sum(a * b for a, b in pattern) <= capacity
            for length, times in pattern:
                used[length] = used.get(length, 0) + times * packs
        assert used == {k: n for k, n in histogram.items() if n}
