"""Held-out accuracy; probabilities of the models."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilescape.llm import language_id as L
from tilescape.llm.queries import op9_language_id


def test_held_out(spark):
    base = "/root/testdata/sf0.1"
    out = op9_language_id(spark, base).join(spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = out.where("held_out").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).first()
    assert r["right"] / r["n"] > 0.99
    assert out.where("score < 0 or score > 1 or score is null").isEmpty()


def test_probabilities_sum_to_one():
    text = "the cat and the dog and the end of the day"
    g, n = np.unique(L.grams(L.folded(text), L.ORDER), return_counts=True)
    alphabet = 30
    m = L.group_models({"en": L.kneser_ney(g, n, alphabet)}, alphabet)
    for context in (" th", "the", "zzz", " an"):
        head = 0
        for c in context:
            head = head << L.BITS | ord(c)
        seen = sorted({int(x) & 0xFFF for x in g})
        p = np.exp2(m.log2(np.array([(head << L.BITS) | c for c in seen], np.uint64))[:, 0].astype(float)).sum()
        rest = np.exp2(float(m.log2(np.array([(head << L.BITS) | 0x7FF], np.uint64))[0, 0]))
        assert p + rest * (alphabet - len(seen)) == pytest.approx(1, abs=1e-4)


class Dictionary:
    """Interpolated Kneser-Ney by the definition, with dictionaries of strings."""

    def __init__(self, texts, alphabet):
        self.alphabet, self.counts = alphabet, {}
        top = Counter()
        for t in texts:
            padded = " " * (L.ORDER - 2) + t
            top.update(padded[i : i + L.ORDER] for i in range(len(padded) - L.ORDER + 1))
        self.counts[L.ORDER] = top
        for k in range(L.ORDER - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.total, self.followers, self.discount = {}, {}, {}
        for k, c in self.counts.items():
            self.total[k], self.followers[k] = Counter(), Counter()
            for g, n in c.items():
                self.total[k][g[:-1]] += n
                self.followers[k][g[:-1]] += 1
            ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            self.discount[k] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / self.alphabet
        lower, head, d = self.p(gram[1:]), gram[:-1], self.discount[k]
        if not self.total[k][head]:
            return lower
        return max(self.counts[k][gram] - d, 0) / self.total[k][head] + d * self.followers[k][head] / self.total[k][head] * lower


def test_models_against_a_dictionary(spark, documents):
    """Cross-entropies and choices of a whole small corpus, worked out with dictionaries."""
    rng = random.Random(6)
    letters = {"aa": "abcde éh", "bb": "abxyz ñh", "cc": "aeiou ßh"}
    text = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randint(3, 60)))
    learned = [(i, text(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 25)]
    m = L.train(spark, documents(learned))
    clean = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    of = lambda lang: [clean(t) for _, t, x in learned if x == lang and clean(t).strip()]
    alphabet = 1 + len({c for lang in letters for t in of(lang) for c in t[1:]})
    plain = {lang: Dictionary(of(lang), alphabet) for lang in letters}
    for _ in range(150):
        t = text(rng.choice(list(letters))) + rng.choice(["", "q", " 漢"])
        if not clean(t).strip():
            continue
        padded = " " * (L.ORDER - 2) + clean(t)
        grams = [padded[i : i + L.ORDER] for i in range(len(padded) - L.ORDER + 1)]
        bits = {lang: -sum(math.log2(d.p(g)) for g in grams) / len(grams) for lang, d in plain.items()}
        lang, _, entropy, _ = m(t)
        assert entropy == pytest.approx(min(bits.values()), abs=1e-4)
        assert bits[lang] == pytest.approx(min(bits.values()), abs=1e-4)


def test_the_texts_with_the_smallest_hashes_are_learned(spark, documents):
    df = documents([(i, "ab" if i % 2 else "cd", "xx") for i in range(3000)] + [(9000, "zz", "yy")])
    first = [r["doc_id"] for r in df.where("lang = 'xx'").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 11), "doc_id").limit(100).collect()]
    m = L.train(spark, df, per_language=100)
    only = L.train(spark, df.where(F.col("doc_id").isin(first) | (F.col("doc_id") == 9000)), per_language=100)
    for a, b in zip(m.groups[0].value.tables, only.groups[0].value.tables, strict=True):
        assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))


def test_groups_are_bounded_by_their_n_grams(monkeypatch):
    monkeypatch.setattr(L, "GROUP_GRAMS", 100)
    assert L.grouped({"a": 60, "b": 30, "c": 30, "d": 500, "e": 1}) == [["a", "b"], ["c"], ["d"], ["e"]]
    monkeypatch.setattr(L, "GROUP", 1)
    assert L.grouped({"b": 1, "a": 1}) == [["a"], ["b"]] and L.grouped({}) == []


@pytest.fixture(scope="module")
def model(spark, documents):
    en = [(i, "this is the text of an english page about the weather and the sea", "en") for i in range(5)]
    fr = [(10 + i, "ceci est le texte d'une page en français sur le temps et la mer", "fr") for i in range(5)]
    return L.train(spark, documents(en + fr + [(99, None, "xx"), (98, "no language", None)]))


def test_edges(spark, documents, model):
    rows = [(1, None), (2, ""), (3, " 12 ?! 42"), (4, "the weather"), (5, "le temps et la mer"), (5, "le temps et la mer"), (6, "the sea " * 50_000), (7, "漢字漢字")]
    got = L.identify(documents(rows, score="clash", bits="clash"), model).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and [by[i]["lang_pred"] for i in range(1, 7)] == ["und", "und", "und", "en", "fr", "en"]
    assert by[1]["score"] == 0 and by[7]["lang_pred"] in ("en", "fr") and by[7]["rejected"] and by[7]["score"] < 0.5
    assert L.identify(documents([]), model).count() == 0


def test_nothing_to_learn(spark, documents):
    empty = L.train(spark, documents([]))
    assert L.identify(documents([(1, "some text")]), empty).first()["lang_pred"] == "und"


def test_many_languages_make_groups(spark, documents, monkeypatch):
    monkeypatch.setattr(L, "GROUP", 2)
    words = {"aa": "zaza zuzu zozo", "bb": "kiki kuku koko", "cc": "mimi mumu momo"}
    m = L.train(spark, documents([(i, f"{w} {w}", lang) for i, (lang, w) in enumerate(words.items())]))
    assert len(m.groups) == 2
    for lang, w in words.items():
        assert m(w)[0] == lang


def test_every_language_is_learned(spark, documents):
    """More than 256 languages, each with a letter pair of its own; the ones with fewest documents too."""
    rows = [(i, f"{chr(97 + i % 20)}{chr(0x3B1 + i // 20)}" * 20, f"x{i:03}") for i in range(300)]
    more = [(1000 + i, t, lang) for i, t, lang in rows[:280]]
    m = L.train(spark, documents(rows + more))
    assert sum(len(g.value.langs) for g in m.groups) == 300
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(documents(rows), m).collect()}
    assert got == {i: lang for i, _, lang in rows}
