import random
import re
import time

from plexus.llm import decontaminate as d


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def corrupt(s, n):
    s = list(s)
    for _ in range(n):
        k = random.randrange(len(s))
        random.choice([lambda: s.pop(k), lambda: s.insert(k, "#"), lambda: s.__setitem__(k, "@")])()
    return "".join(s)


def test_matches_brute_force(spark):
    random.seed(9)
    word = lambda: "".join(random.choice("aeioulnrst") for _ in range(random.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(random.randint(5, 40)).capitalize()) for i in range(12)] + [(50, "short one here"), (51, None), (52, " \n ")]
    items += [(60 + n, prose(n)[:n].strip() or "x") for n in range(3, 40, 3)] + [(99, "art")]
    docs = []
    for i in range(60):
        text = prose(random.randint(0, 150))
        for _ in range(random.randint(0, 2)):
            k, item = random.choice([x for x in items if x[0] not in (51, 52)])
            budget = d.budget(len(item))
            text += " " + corrupt(item, random.choice([0, 0, budget, budget + 1, 2 * budget + 3])).replace(" ", "\n", 1) + " " + prose(random.randint(0, 40))
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "x"), (103, "a cartwheel"), (104, "the ART of")]
    expected = set()
    for k, text in docs:
        for i, item in items:
            x, y = d.normal(item or ""), d.normal(text or "")
            if not x:
                continue
            if len(x) < d.Q:
                if x in re.findall(rf"(?=(?<!\w)({re.escape(x)})(?!\w))", y):
                    expected.add((k, i, 0))
            elif (e := slow_distance(x, y)) <= d.budget(len(x)):
                expected.add((k, i, e))
    assert (104, 99, 0) in expected and (103, 99, 0) not in expected
    dd = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, edits int")
    ii = spark.createDataFrame(items, "item_id long, text string")
    assert len(expected) > 20
    assert {(r.doc_id, r.item_id, r.edits) for r in d.find_items(dd, ii).collect()} == expected
    assert {(r.doc_id, r.item_id, r.edits) for r in d.find_items(dd, ii, block_chars=300).collect()} == expected
    left = {k for k, _ in docs} - {k for k, _, _ in expected}
    for size in (d.BLOCK_CHARS, 300):
        assert {r.doc_id for r in d.clean(dd, ii, size).collect()} == left


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_items(odd_docs, none).count() == 0
    one = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    assert d.find_items(no_docs, one).count() == 0
    assert {r.doc_id for r in d.find_items(odd_docs, one).collect()} == {4, 5}


def test_budget_keeps_the_bound_positive():
    for n in range(d.Q, 3000):
        e = d.budget(n)
        assert n + 1 - d.Q * (e + 1) >= 1 and (e == int(d.RATE * n) or n + 1 - d.Q * (e + 2) < 1)


def test_item_of_thirty_characters_with_one_edit():
    block = d.ItemBlock([(1, "a benchmark item of 30 letters")])
    assert [x[:2] for x in block.search("so a benchmark itemm of 30 letters it is")] == [(1, 1)]


def test_runs_of_one_character():
    """A q-gram that fills item and text costs a few cells a place."""
    item = "a" * 4000
    block = d.ItemBlock([(1, item), (2, "b" + "a" * 300 + "c"), (3, "d" * 50)])
    began = time.perf_counter()
    found = list(block.search("x" * 500 + "a" * 1_000_000))
    assert [x[:2] for x in found] == [(1, 0), (2, 2)] and found[0][2] == 500
    assert time.perf_counter() - began < 60


def test_null_and_repeated_ids(spark):
    leak, fine = "some item of the benchmark in a text", "nothing of that kind here"
    docs = spark.createDataFrame([(None, leak, 1), (7, leak, 2), (7, fine, 3), (None, fine, 4), (8, None, 5)], "doc_id long, text string, start int")
    items = spark.createDataFrame([(1, "some ITEM of the\nbenchmark")], "item_id long, text string")
    assert sorted(r.start for r in d.clean(docs, items).collect()) == [3, 4, 5]
    assert d.find_items(docs, items).count() == 2
