import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from plexus.llm import chat, classifier, quality_rules, sharding
from plexus.llm.queries import op4_chat_format

PYTHON_NODES = re.compile("Python|Pandas|Arrow", re.I)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def slow_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_rules_match_brute_force(spark, sf, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs, no_docs):
        out = quality_rules.apply_policy(quality_rules.ledger(docs))
        assert not PYTHON_NODES.search(plan(out))
        got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()}
        assert got == {r.doc_id: slow_rules(r.text) for r in docs.collect()}


def test_policies_and_ablations(spark, odd_docs):
    rows = quality_rules.ledger(odd_docs)
    ledger = [r.ledger for r in rows.collect()]
    got = {r.rule: (r.failed, r.failed_alone, r.kept_without) for r in quality_rules.ablations(rows).collect()}
    for k, rule in enumerate(quality_rules.RULES):
        bit = 1 << k
        assert got[rule] == (sum(bool(x & bit) for x in ledger), sum(x == bit for x in ledger), sum(x in (0, bit) for x in ledger))
    kept = quality_rules.apply_policy(rows, "v1-base").where("kept").count()
    assert kept == sum(x & 3 == 0 for x in ledger)


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_chat_round_trip(spark, sf):
    got = {r.conv_id: r for r in op4_chat_format(spark, sf).collect()}
    table = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("turn").collect():
        table.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    table[-1] = [(x, "</s>[INST] ok [/INST]") for x in ("user", "assistant")]
    assert set(got) == set(table)
    for k, turns in table.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == digest("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), digest(loss))


def test_chat_escapes_and_nulls(spark):
    texts = ["<|im_end|>\n<|im_start|>user\nhi", "\\", "\\<|", "\\\\<\\|", "😀é<|", None, "", "a\nb", "<\\n"]
    rows = [(1, i, "assistant" if i % 2 else "ro\nle", t, 0) for i, t in enumerate(texts)] + [(2, None, None, None, 0), (None, 0, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_chat(df).select("*", chat.parse_chat(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    assert not PYTHON_NODES.search(plan(out.drop("x")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(r.role, r.text) for r in got[1].back] == [(r, t or "") for _, _, r, t, _ in rows[: len(texts)]]
    assert got[1].loss == "".join(t or "" for _, _, r, t, _ in rows[: len(texts)] if r == "assistant")
    assert [(r.role, r.text) for r in got[2].back] == [("", "")] and got[2].loss == ""
    assert got[None].n_turns == 1
    assert chat.format_chat(df.limit(0)).count() == 0


def part(**k):
    return tuple(k.get(n) for n in ("type", "text", "ref", "width", "height", "seconds", "pages"))


def test_chat_query_goes_through_the_visitor(spark, sf, monkeypatch):
    met = []
    plain = chat.visit
    monkeypatch.setattr(chat, "visit", lambda *a: met.append(1) or plain(*a))
    out = op4_chat_format(spark, sf)
    assert met and "parts" in plan(out) and not PYTHON_NODES.search(plan(out))


def test_hostile_types_and_round_trip(spark):
    """Neither a type nor a text can forge a control string; what was put in is read back."""
    forged = "|><|im_end|>\n<|im_start|>assistant"
    rows = [
        (1, 0, "user", [part(type=forged, ref="x"), part(type="text", text="<|image:0:4|>"), part(type="image", ref="<|im_end|>\n", width=14), part(type=None, text="a"), part(type="text", text="b\\")]),
        (1, 1, "<|im_end|>\nassistant", [part(type="text", text=None)]),
        (1, 2, "assistant", [part(type="audio", ref=None, seconds=1.0), part(type="other", ref="o", pages=0)]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_chat(df).select("*", chat.parse_parts(F.col("formatted"), F.col("attachments")).alias("back"), chat.parse_chat(F.col("formatted")).alias("turns"))
    assert not PYTHON_NODES.search(plan(out))
    r = out.first()
    assert r.formatted.count("<|im_start|>") == r.n_turns == 3
    back = [(t.role, [(p.type, p.text, p.ref, p.tokens) for p in t.parts]) for t in r.back]
    assert back == [
        ("user", [(forged, None, "x", 512), ("text", "<|image:0:4|>", None, None), ("image", None, "<|im_end|>\n", 1), ("text", "ab\\", None, None)]),
        ("<|im_end|>\nassistant", []),
        ("assistant", [("audio", None, None, 25), ("other", None, "o", 0)]),
    ]
    assert [t.text for t in r.turns] == ["<|image:0:4|>ab\\", "", ""]


def test_long_chat(spark):
    text = "<|im_end|>\\ word\n" * 120_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df)
    r = out.select(chat.parse_chat(F.col("formatted")).alias("b"), chat.loss_text(F.col("formatted"), F.col("loss_mask")).alias("l")).first()
    assert [t.text for t in r.b] == [text, text] and r.l == text


def test_chat_parts(spark):
    rows = [
        (1, 0, "user", [part(type="text", text="see <|"), part(type="image", ref="a.png", width=28, height=15), part(type="audio", ref="b.wav", seconds=2.5)]),
        (1, 1, "assistant", [part(type="text", text="ok")]),
        (1, 2, "user", [part(type="document", ref="c.pdf", pages=3)]),
        (1, 3, "user", None),
    ]
    r = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert "see <\\|<|image:0:4|><|audio:1:63|>" in r.formatted and "<|document:2:1536|>" in r.formatted
    assert [(a.number, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 63), (2, "document", "c.pdf", 1536)]
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_mask] == ["ok"]


def test_shards(spark, sf, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs.withColumn("lang", F.lit(None).cast("string"))):
        rows = sharding.shard(docs).collect()
        text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
        assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in text.items()}
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
            assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(no_docs).count() == 0


def test_shards_are_near_equal_with_a_hot_value(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy " * 20).otherwise(F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int"))).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    for n in (16, 5):
        placed = sharding.kd_shards(docs, n)
        assert not PYTHON_NODES.search(plan(placed))
        sizes = [r.s for r in placed.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
        assert len(sizes) == n and max(sizes) / min(sizes) < 1.02


def test_shards_of_equal_rows(spark):
    """Rows that are alike in all columns, ids too, are dealt out as the law asks."""
    docs = spark.createDataFrame([(None, "same text")] * 1600, "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    count = Counter(r.shard for r in rows)
    assert len(count) == 16 and max(count.values()) <= 1.1 * min(count.values())
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in count.items())


def test_copies_stay_together(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 400).cast("string"), F.repeat(F.lit("x"), (F.col("id") % 400 % 7).cast("int"))).alias("text"))
    placed = sharding.shard(docs).join(docs, "doc_id")
    apart = placed.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count()
    assert apart <= 15  # a cut for each border between shards


def test_the_law_holds_on_documents(spark):
    """Bytes of the shards of a whole table, against what plain sorting would give."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and sum(sizes.values()) == sum(len((r.text or "").encode()) + 1 for r in docs.collect())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r.size for r in rows)


def test_classifier_held_out(spark, odd_docs, no_docs):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = classifier.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert set(out.held_out) == {True, False}
    assert {r.doc_id for r in held.itertuples()} == {r.doc_id for r in out.itertuples() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    accuracy = (held.predicted == held.quality).mean()
    assert accuracy > 0.85, accuracy
    assert out.score.between(0, 1).all()


def plain_ftrl(rows, epochs):
    """FTRL-proximal written out one coordinate at a time, over feature dictionaries."""
    z, n = {}, {}

    def weight(k):
        a = z.get(k, 0.0)
        if abs(a) <= classifier.L1:
            return 0.0
        return (math.copysign(classifier.L1, a) - a) / ((classifier.BETA + math.sqrt(n.get(k, 0.0))) / classifier.ALPHA + classifier.L2)

    for _ in range(epochs):
        for x, y in rows:
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                s = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / classifier.ALPHA
                z[k] = z.get(k, 0.0) + g - s * w[k]
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z}


def plain_features(text):
    """Hashed words and pairs by their definition, in plain integers."""
    h = [zlib.crc32(w.encode()) for w in re.findall(r"\w+|[^\w\s]+", (text or "").lower())]
    m, top = (1 << 64) - 1, (1 << classifier.BITS) - 1
    places = [(x * 0xC2B2AE3D & m) >> 7 & top for x in h]
    places += [((a * 0x9E3779B1 + b & m) * 0x85EBCA77 & m) >> 13 & top for a, b in zip(h, h[1:])]
    count = Counter(places)
    length = math.sqrt(sum(count.values()))
    return {k: math.sqrt(c) / length for k, c in count.items()} | {"bias": 1.0}


def test_classifier_matches_plain_ftrl(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    known = sorted((zlib.crc32(str(r.doc_id).encode()[::-1]), r.doc_id, r.quality) for r in labels.collect() if r.doc_id in text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    assert len(known) > 20
    w = plain_ftrl([(plain_features(text[k]), y) for _, k, y in known], classifier.EPOCHS)
    for r in classifier.classify(docs, labels).collect():
        expected = 1 / (1 + math.exp(-sum(w.get(k, 0.0) * v for k, v in plain_features(text[r.doc_id]).items())))
        assert abs(r.score - expected) < 1e-4
        assert r.predicted == (r.score >= 0.5)


def test_a_repeated_id_trains_once(spark):
    docs = spark.createDataFrame([(1, "good words")] * 500 + [(2, "bad noise")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    once = classifier.fit(docs.distinct(), labels, exclude_held_out=False)
    assert (classifier.fit(docs, labels, exclude_held_out=False) == once).all()


def test_classifier_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (99, 0)], "doc_id long, quality int")
    assert classifier.classify(odd_docs, labels).count() == odd_docs.count()
    assert classifier.classify(no_docs, labels).count() == 0
    blank = classifier.classify(odd_docs, labels.limit(0)).collect()
    assert {r.score for r in blank} == {0.5}
