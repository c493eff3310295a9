"""Base counts against a plain reading of their definition; the verdict on planted junk."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilescape.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #\n\té \x1c漢", max_size=120))
def test_base_counts(text):
    assert quality.judge_text(text.encode(), None, {}, quality.Rules())[:6] == brute(text)


def test_whole_table(spark, sample):
    df, rows = sample
    got = {r["doc_id"]: r for r in quality.judge(spark, df).collect()}
    for r in rows:
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"], g["base_failed"]) == brute(r["text"])
        assert not (g["base_failed"] and g["kept"])


def test_references_are_the_corpus_counts(spark, documents):
    df = documents([(1, "the cat the dog"), (2, "the end", "en"), (3, "le chat", "fr"), (4, "x", None)])
    refs = quality.references(spark, df)
    assert set(refs) == {"en", "fr"} and refs["en"].shares[refs["en"].words[b"the"]] == 3 and refs["en"].shares.sum() == 6


def plain_class(c):
    """The class of a character, by a plain reading."""
    named = {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "white": " \t\n\x0b\x0c\r", "stop": ".,;:?!", "quote": "'\"()-_/", "symbol": "#*$%&|<>=+~^\\{}[]@`"}
    for name, members in named.items():
        if c in members:
            return name
    k = unicodedata.category(c)
    if k[0] in "LM" or 0x20000 <= ord(c) < 0x40000:  # the planes of ideographs
        return "letter"
    return {"N": "digit", "Z": "white", "S": "symbol"}.get(k[0], "stop" if k == "Po" else "quote" if k[0] == "P" else "other")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_classes_are_those_of_characters(text):
    got = quality.class_counts(text.encode(), quality.byte_counts(text.encode()))
    expected = Counter(map(plain_class, text))
    assert dict(zip(quality.CLASSES, got.tolist(), strict=True)) == {k: expected.get(k, 0) for k in quality.CLASSES}


def plain_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0.0, (part(p, q) + part(q, p)) / 2))


def test_distances_and_verdicts_against_a_plain_count(spark, sample):
    """Common words, medians of class shares and both distances of every document, counted in Python."""
    df, rows = sample
    rules, words, shares = quality.Rules(), {}, {}
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    for r in rows:
        if r["text"] and r["lang"]:
            words.setdefault(r["lang"], Counter()).update(WORD.findall(lower(r["text"])))
            seen = Counter(map(plain_class, r["text"]))
            shares.setdefault(r["lang"], []).append([round(quality.STEPS * seen[k] / len(r["text"])) for k in quality.CLASSES])
    refs = {}
    for lang, counted in words.items():
        common = sorted(counted.items(), key=lambda x: (-x[1], x[0].encode()))[: rules.common_words]
        medians = [sorted(x)[(len(x) - 1) // 2] for x in zip(*shares[lang], strict=True)]
        refs[lang] = ([w for w, _ in common], [n for _, n in common] + [sum(counted.values()) - sum(n for _, n in common)], medians)
    got = {r["doc_id"]: r for r in quality.judge(spark, df).collect()}
    for r in rows:
        text, (common, counts, medians), g = r["text"] or "", refs[r["lang"]], got[r["doc_id"]]
        seen, split = Counter(map(plain_class, text)), WORD.findall(lower(text))
        by_char = plain_distance([seen[k] for k in quality.CLASSES], medians) if len(text) >= rules.min_chars else None
        own = Counter(split)
        by_word = plain_distance([own[w] for w in common] + [len(split) - sum(own[w] for w in common)], counts) if len(split) >= rules.min_words else None
        assert g["char_distance"] == (by_char if by_char is None else pytest.approx(by_char, abs=1e-9))
        assert g["word_distance"] == (by_word if by_word is None else pytest.approx(by_word, abs=1e-9))
        assert g["kept"] == (not g["base_failed"] and (by_char or 0) <= rules.max_char_distance and (by_word or 0) <= rules.max_word_distance)


def test_very_long_text(spark, documents):
    got = quality.judge(spark, documents([(1, "some words in a row " * 60_000), (2, "é" * 300_000)])).orderBy("doc_id").collect()
    assert got[0]["n_repeat_words"] == got[0]["n_words"] == 300_000 and not got[0]["kept"] and got[1]["word_chars"] == 300_000


def test_distance():
    a, b = np.array([1.0, 0]), np.array([0, 1.0])
    assert quality.distance(a, b) == 1 and quality.distance(a, a) == 0


def test_junk_goes_and_prose_stays(spark, sample):
    df, rows = sample
    clean = [r for r in rows if r["text"] and 400 < len(r["text"]) < 3000 and not re.search(r"[#*$%&|]|!!", r["text"]) and not brute(r["text"])[5]]
    rng = random.Random(2)
    junk = [(10_000 + i, " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in r["text"].split()), r["lang"]) for i, r in enumerate(clean[:20])]
    extra = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in junk], df.schema)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark, df.union(extra)).collect()}
    assert not any(got[i] for i, _, _ in junk)
    assert sum(got[r["doc_id"]] for r in clean) >= 0.97 * len(clean)


def test_filter_passes_columns_through(spark, documents):
    df = documents([(1, None), (2, ""), (3, "word " * 5), (4, None, None)], kept="mine", n_words=3)
    assert quality.keep_good(spark, df).columns == df.columns and quality.keep_good(spark, df).count() == 0
    assert quality.judge(spark, documents([])).count() == 0
    assert quality.judge(spark, df).count() == 4


def test_every_language_has_references(spark, documents, monkeypatch):
    """More languages than a group, in more groups than a process keeps: each document is judged by its own."""
    monkeypatch.setattr(quality, "GROUP", 30)
    rows = [(i, f"{chr(97 + i % 20)}x{i} {chr(97 + i // 20)}y{i} " * 100, f"l{i:03}") for i in range(300)]
    df = documents(rows + [(1000 + i, t, lang) for i, t, lang in rows[:280]])
    refs = quality.references(spark, df)
    assert len(refs) == 300 and set(refs) == {lang for _, _, lang in rows} and "l0000" not in refs
    got = quality.judge(spark, documents([*rows, (2000, rows[299][1], None), (2001, rows[299][1], "unknown")]), refs=refs).collect()
    assert len(got) == 302 and all(r["word_distance"] < 1e-6 for r in got)
