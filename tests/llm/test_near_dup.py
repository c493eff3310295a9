"""Near-duplicates against brute force over all pairs."""

import random
import re
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from tilescape.llm import near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def run(spark, df, width, percent):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark, df, width=width, percent=percent).collect()}


def test_whole_table(spark, sample):
    df, rows = sample
    pairs = [(r["doc_id"], r["text"]) for r in rows]
    assert run(spark, df, 3, 85) == brute(pairs, 3, 85)
    assert run(spark, df, 5, 80) == brute(pairs, 5, 80)


def test_edges_of_the_contract(spark, documents):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE two"), (6, "one"), (7, "a b c d"), (8, "A B C D"), (9, "a b c d")]
    got = run(spark, documents(rows, kept=True, component_id=7, digest="x"), 3, 85)
    assert got == brute(rows, 3, 85)
    assert got[5] == (1, 4, False) and got[3] == (0, 3, True)
    assert near_dup.near_duplicates(spark, documents([])).count() == 0


def test_repeated_rows_and_null_ids(spark, documents):
    df = documents([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)])
    out = near_dup.near_duplicates(spark, df, width=3, percent=85).collect()
    assert len(out) == 4 and sum(r["kept"] for r in out) == 3  # both rows of document 1, and the wordless one


def test_repeated_ids_with_different_texts_and_nulls(spark, documents):
    one, other = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    near = lambda words: " ".join([*words[:-1], "tail"])
    df = documents([(5, " ".join(one)), (5, " ".join(other)), (7, near(one)), (3, near(other)), (None, near(one) + " more"), (None, "x y z u v"), (None, "x y z u v")])
    for _ in range(2):
        out = near_dup.near_duplicates(spark, df.repartition(5), width=3, percent=85).collect()
        expected = [(5, 5, True), (5, 3, False), (7, 5, False), (3, 3, True), (None, 5, False), (None, None, True), (None, None, True)]
        assert sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out), key=repr) == sorted(expected, key=repr)


def test_any_64_bit_ids(spark, documents):
    words = [f"w{i}" for i in range(80)]
    ids = [2**62, 2**62 + 1, 2**63 - 1, -(2**62), -(2**63), 0]
    rows = [(i, " ".join([*words[:-1], f"t{k}"])) for k, i in enumerate(ids)] + [(2**63 - 2, "something else entirely here"), (-5, "something else entirely here")]
    assert run(spark, documents(rows), 3, 85) == brute(rows, 3, 85)


def test_large_groups_that_share_rare_shingles(spark, documents):
    """Two large components that meet in shingles no other text has, and a text that is like neither."""
    left, right = [f"l{i}" for i in range(100)], [f"r{i}" for i in range(100)]
    rows = [(i, " ".join([*left, "meet here now please", f"x{i}"])) for i in range(150)] + [(1000 + i, " ".join([*right, "meet here now please", f"y{i}"])) for i in range(150)]
    rows.append((500, " ".join([*left[:52], "meet here now please", *right[48:]])))
    assert run(spark, documents(rows), 3, 85) == brute(rows, 3, 85)


def test_chains_and_wrong_centres(spark, documents):
    """Groups whose smallest id is no neighbour of most members: links between the others must be found."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for group in range(6):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(40):
            words = list(base)
            for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 7])):
                words[at] = rng.choice(vocabulary)
            rows.append((len(rows) + group * 1000, " ".join(words)))
    assert run(spark, documents(rows), 3, 85) == brute(rows, 3, 85)


def test_very_long_text(spark, documents):
    words = " ".join(f"x{i}" for i in range(120_000))
    got = run(spark, documents([(1, words), (2, words + " tail")]), 3, 85)
    assert got[2][1] == 1 and got[1][0] == 119_998


def test_first_permutation_is_one():
    first = near_dup._first()
    assert len(set(first.tolist())) == near_dup.UNIVERSE and first.min() == 0 and first.max() == near_dup.UNIVERSE - 1


def test_band_length_keeps_the_miss_rate():
    for percent in (50, 80, 85, 95):
        r = near_dup.rows_per_band(percent)
        assert r == 1 or (1 - (percent / 100) ** r) ** near_dup.BANDS <= near_dup.MISS


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.integers(1, 4))
def test_shingle_counts(words, width):
    text = " ".join(words)
    assert len(near_dup.shingles(text.encode(), width)) == len(shingle_set(text, width))
