"""Edit matching against the plain distance table."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilescape.llm import decontaminate as D


def best_distance(pattern, text):
    """Least edits of the pattern anywhere in the text, by the plain table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé", min_size=1, max_size=12), st.text(alphabet="abé", max_size=30))
def test_bit_parallel_distance(pattern, text):
    assert D.myers(pattern, text)[0] == best_distance(pattern, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_search_finds_what_brute_force_finds(seed):
    rng = random.Random(seed)
    items = tuple((i, "".join(rng.choice("abcd ") for _ in range(40)).strip().ljust(30, "x")) for i in range(3))
    text = list("".join(rng.choice("abcd ") for _ in range(60)) + items[0][1] + "".join(rng.choice("abcd ") for _ in range(30)))
    for _ in range(rng.randint(0, 6)):
        at = rng.randrange(len(text))
        text[at] = rng.choice(["", "z", text[at] + "q"])
    text = "".join(text)
    got = {i: d for i, d, _, _ in D.Matcher(items, 0.1).search(text)}
    expected = {i: d for i, p in items if (d := best_distance(p, text)) <= D.budget(len(p), 0.1)}
    assert got == expected


def test_templated_items_are_found_and_cost_little():
    """Ten thousand items of one template; a text with the template, and with a few of the items."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9))
    items = tuple((i, f"question: what is the name of the thing that we call {word()} {word()} {word()} {word()}") for i in range(10_000))
    matcher = D.Matcher(items, 0.1)
    text = f"{'some words ' * 40} question: what is the name of the thing that we call otherwise. {items[77][1]} and {items[4242][1].replace('thing', 'thong')}"
    began = time.process_time()
    got = {i: d for i, d, _, _ in matcher.search(text)}
    took = time.process_time() - began
    expected = {77: 0, 4242: 1}
    assert {i: got[i] for i in expected} == expected
    for i in rng.sample(range(10_000), 30):
        assert (i in got) == (best_distance(items[i][1], text) <= D.budget(len(items[i][1]), 0.1))
    assert took < 5 and len(got) < 20


def test_counting_many_items_at_once_changes_nothing(monkeypatch):
    rng = random.Random(2)
    items = tuple((i, "".join(rng.choice("abcd ") for _ in range(rng.randint(26, 60)))) for i in range(60))
    texts = ["".join(rng.choice("abcd ") for _ in range(50)).join(rng.choice(items)[1][rng.randint(0, 3) :] for _ in range(4)) for _ in range(40)]
    matcher = D.Matcher(items, 0.1)
    first = [sorted(matcher.search(t)) for t in texts]
    monkeypatch.setattr(D, "FEW", -1)
    assert [sorted(matcher.search(t)) for t in texts] == first and any(first)


def test_very_long_texts_and_null_ids(spark, documents, benchmark):
    item = benchmark.first()
    df = documents([(None, item["text"]), (None, "nothing of it"), (1, "word and word " * 40_000 + item["text"])])
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(spark, df, benchmark).collect()} == {(None, item["item_id"]), (1, item["item_id"])}
    assert [(r["doc_id"], r["text"]) for r in D.without_leaks(spark, df, benchmark).collect()] == [(None, "nothing of it")]


def test_whole_table_against_brute_force(spark, sample, benchmark):
    """Every text that is short enough for the plain table, against every item."""
    df, rows = sample
    items = {r["item_id"]: D.normalised(r["text"]) for r in benchmark.collect()}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in D.leaks(spark, df, benchmark).collect()}
    short = [r for r in rows if r["text"] and len(r["text"]) < 700]
    expected = {(r["doc_id"], i): d for r in short for i, t in items.items() if (d := best_distance(t, D.normalised(r["text"]))) <= D.budget(len(t), 0.1)}
    assert {k: v for k, v in got.items() if k[0] in {r["doc_id"] for r in short}} == expected and got


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_planted_passages(spark, documents, benchmark):
    items = benchmark.orderBy("item_id").collect()
    rng = random.Random(3)
    rows, expected = [], {}
    for n, item in enumerate(items[:20]):
        words = item["text"].split(" ")
        if n % 2:
            words[rng.randrange(len(words))] = "zz"  # a few edits
        rows.append((n, "before it . " + "\n ".join(words).upper() + " after it"))
        expected[n] = item["item_id"]
    rows += [(100, None), (101, ""), (102, "nothing of the kind in here"), (103, " ".join(items[0]["text"].split()[: len(items[0]["text"].split()) // 2]))]
    df = documents(rows, item_id="clash", distance="clash")
    got = {r["doc_id"]: r["item_id"] for r in D.leaks(spark, df, benchmark).collect()}
    assert got == expected
    kept = D.without_leaks(spark, df, benchmark)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {100, 101, 102, 103}


def test_whole_table_has_every_exact_passage(spark, sample, benchmark):
    df, rows = sample
    items = [D.normalised(r["text"]) for r in benchmark.collect()]
    exact = {r["doc_id"] for r in rows if any(t in D.normalised(r["text"]) for t in items)}
    assert exact <= {r["doc_id"] for r in D.leaks(spark, df, benchmark).collect()}


def test_empty_benchmarks_and_shards(spark, documents, benchmark, monkeypatch):
    df = documents([(1, "some text"), (1, "some text")])
    nothing = benchmark.where("false")
    assert D.leaks(spark, df, nothing).count() == 0 and D.without_leaks(spark, df, nothing).count() == 2
    item = benchmark.first()["text"]
    monkeypatch.setattr(D, "SHARD_CHARS", 500)
    assert [r["doc_id"] for r in D.leaks(spark, documents([(1, item), (1, item)]), benchmark).collect()] == [1, 1]
    assert D.leaks(spark, documents([]), benchmark).count() == 0


def test_short_items_are_found_at_bounds_of_words(spark, documents):
    items = [(1, "Who wrote Hamlet?"), (2, "中华民国成立于哪一年"), (3, "Name the red planet"), (4, "yes"), (5, "it is so"), (6, "our ten art kings")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "quiz: who  wrote hamlet? shakespeare did"),
        (2, "请问中华民国成立于哪一年呢"),
        (3, "(name the rad planet)"),  # one edit of 19 characters
        (4, "yes it is so"),
        (5, "four ten art kingship"),
        (6, "nothing of it"),
        (7, None),
    ]
    docs = documents(rows)
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in D.leaks(spark, docs, benchmark).collect()}
    assert got == {(1, 1, 0), (2, 2, 0), (3, 3, 1)}
    assert {r["doc_id"] for r in D.without_leaks(spark, docs, benchmark).collect()} == {4, 5, 6, 7}
