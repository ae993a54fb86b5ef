"""The pipeline's stages against plain Python, each on its predecessor's rows."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from plexus.llm import classifier, decontaminate, simhash, tokens
from plexus.llm.common import materialize

from .test_jaccard import kept
from .test_suffixdedup import brute

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], D), name.replace(" ", "-")))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    for df in stages[1:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS)


def test_quality_stage(spark, stages):
    weights = classifier.fit(stages[0], spark.read.parquet(f"{D}/labels.parquet")).astype(float)
    kept = set()
    for k, r in rows(stages[0]).items():
        place, value = classifier.features(r.text)
        if 1 / (1 + np.exp(-(weights[place] @ value + weights[-1]))) >= 0.5:
            kept.add(k)
    assert set(rows(stages[1])) == kept


def test_near_dedup_stage(stages):
    before = rows(stages[1])
    assert set(rows(stages[2])) == kept([(k, r.text) for k, r in before.items()])


def test_repeats_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    cut = brute(sorted((k, r.text) for k, r in before.items()))
    for k, r in before.items():
        size, removed, _, digest = cut[k]
        if not removed:
            assert after[k].text == r.text
        elif k in after:
            assert after[k].n_chars == len(after[k].text) < len(r.text)
        else:
            assert removed > 0


def test_decontamination_stage(spark, stages):
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    before, after = rows(stages[3]), rows(stages[4])
    for k, r in before.items():
        text = decontaminate.normal(r.text)
        if any(i in text for i in items):
            assert k not in after
    assert len(after) >= len(before) - 12


def test_packing_stage(stages):
    tk = tokens.library(tokens.public_path("word_bpe_49k.json"))
    docs, pieces = rows(stages[4]), {}
    for r in stages[5].collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(docs)
    for k, own in pieces.items():
        ids = [*tk.encode(docs[k].text, add_special_tokens=False).ids, 1]
        own.sort(key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "q r s t u v"), (2, "w x y z 1 2")], "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    left = corpus_pipeline.near_dedup_stage(spark, docs, D).collect()
    assert sorted(r.text for r in left) == ["a b c d e f", "q r s t u v", "w x y z 1 2"]
    assert simhash.near_groups(docs).count() == 4


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Null and repeated ids, null, empty, blank, repeated and very long texts, a leak, null metadata, and clashing columns."""
    leak = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    long = " ".join(f"word{i * 7919 % 100_003}" for i in range(150_000))
    texts = [(None, None), (None, ""), (1, " \n "), (1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A  b c d e f g"), (None, leak), (3, leak), (3, "h i j k l m n"), (4, long), (5, long + " more"), (6, "é½ \x1c <|endoftext|> o p q r")]
    return spark.createDataFrame([(k, t, None, None, None, "x", 0.5, 7) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long, item_id string, score double, __key long")


@pytest.mark.parametrize("place", range(5))
def test_stages_on_odd_rows_and_empty_tables(spark, odd_rows, place):
    name, stage = corpus_pipeline.STAGES[place]
    out = stage(spark, odd_rows, D)
    got = out.collect()
    assert stage(spark, odd_rows.limit(0), D).count() == 0
    if place < 4:
        assert out.columns == list(corpus_pipeline.COLUMNS)
    texts = [r.text or "" for r in got] if place < 4 else []
    leak = spark.read.parquet(f"{D}/benchmark.parquet").first().text
    if name == "SimHash near-dedup":
        # Of each group one stays: blank texts, the shingle that stands four times, the leak, the long text, and two that are alone.
        assert sorted(len(t) for t in texts if t.split()) == sorted(map(len, ["a b c d e f g", leak, "h i j k l m n", odd_rows.where("doc_id = 4").first().text, "é½ \x1c <|endoftext|> o p q r"]))
        assert sum(not t.split() for t in texts) == 1
    elif name == "suffix-array dedup":
        assert len(got) >= 9 and sum(leak in t for t in texts) == 1
    elif name == "benchmark decontamination":
        assert len(got) == 10 and not any(leak in t for t in texts)
    elif name == "packing":
        ends = {}
        for r in got:
            ends[r.sequence_id, r.offset] = r.length
        assert len(ends) == len(got) and len({r.doc_id for r in got}) == 7
