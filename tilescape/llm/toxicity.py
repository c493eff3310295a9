"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding maps lookalike letters (Cyrillic, Greek, full-width) and digit or sign substitutions to Latin letters,
one character for one, so that offsets and word boundaries stay those of the original. The lexicon's entries are
whole words and word stems with weights learned as smoothed log-odds from labelled texts. Hits inside an exception phrase do not
count. A text's score is a logistic function of its weighted hits, normalised by length.

Defined results: null, empty and wordless texts have no hits and get the score of a text without any; repeated
rows score alike; a document with both labels counts as toxic; with no labels at all only the built-in words count; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.llm.common import bound_batches, texts

#: Lookalikes of Latin letters, and digits and signs that stand for them.
LOOKALIKES = {
    "a": "аαɑ", "b": "Ьβ", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іιı", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "η", "o": "оο",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υ", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "$": "s", "@": "a", "!": "i", "|": "l"}
#: Words that count with the built-in weight whatever the labels say.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "worthless", "disgusting", "trash", "clown")
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clownfish", "trash collection", "pond scum")
SEED_WEIGHT = 4.0
STEM_LENGTHS = range(4, 8)

_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
_TABLE = {ord(c): k for k, v in LOOKALIKES.items() for c in v} | {ord(k): v for k, v in SUBSTITUTES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B)}
_TABLE |= {0xFEE0 + ord(k): v for k, v in SUBSTITUTES.items() if k.isdigit()}
_WORD = re.compile(r"[^\W_]+")


def visible(text: str | None) -> str:
    """Lower case, one character for one, without invisible characters."""
    if not text:
        return ""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low if low.isascii() else _INVISIBLE.sub("", low)


def fold(text: str) -> str:
    return text.translate(_TABLE)


def _part_of_word(c: str) -> bool:
    return c.isalnum() or c in "$@"


@dataclass
class Lexicon:
    """weights of whole words and of stems; phrases that cancel what stands in them; the logistic's coefficients."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    coefficients: tuple[float, float, float] = (-3.0, 2.0, 0.5)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            entries: dict[str, list] = {}
            for kind, listed in ((0, self.words), (1, self.stems)):
                for term, weight in listed.items():
                    entries.setdefault(term, [len(term), 0.0, 0.0, False])[1 + kind] = weight
            for phrase in self.exceptions:
                entries.setdefault(fold(phrase), [len(phrase), 0.0, 0.0, False])[3] = True
            for term, entry in entries.items():
                a.add_word(term, tuple(entry))
            if entries:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str | None) -> tuple[float, int, int]:
        """weight of all hits, number of hits, length in words (white space parted)."""
        low = visible(text)
        if not low:
            return 0.0, 0, 0
        best: dict[int, float] = {}  # by the start of the word, so that a stem and its word count once
        spared: list[tuple[int, int]] = []
        a = self.automaton()
        for last, (n, word, stem, harmless) in a.iter(fold(low)) if len(a) else ():
            start, end = last + 1 - n, last + 1
            if start and _part_of_word(low[start - 1]):
                continue
            closed = end == len(low) or not low[end].isalnum()
            if harmless and closed:
                spared.append((start, end))
            weight = max(word if closed else 0.0, stem)
            if weight > best.get(start, 0.0):
                best[start] = weight
        reach, phrases, kept = 0, iter(sorted(spared)), []
        phrase = next(phrases, None)
        for start in sorted(best):  # both in page order: a word is spared if a phrase that begins at or before it ends behind its start
            while phrase is not None and phrase[0] <= start:
                reach = max(reach, phrase[1])
                phrase = next(phrases, None)
            if start >= reach:
                kept.append(best[start])
        return sum(kept), len(kept), len(low.split())

    def score(self, text: str | None) -> float:
        total, _, n = self.hits(text)
        return logistic(self.coefficients, features(total, n))


def features(total: float, n: int) -> tuple[float, float]:
    """Length-normalised weights: per square root of the words, and per hundred words, both damped."""
    n = max(n, 1)
    return math.log1p(total / math.sqrt(n) * 4), math.log1p(100 * total / n)


def logistic(c: tuple[float, float, float], x: tuple[float, float]) -> float:
    z = c[0] + c[1] * x[0] + c[2] * x[1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a word or a stem, by label."""
    schema = pa.schema([("term", pa.string()), ("stem", pa.bool_()), ("toxic", pa.int32()), ("n", pa.int64())])
    for batch in it:
        found: Counter = Counter()
        for y, t in zip(batch.column("toxic").to_pylist(), texts(batch), strict=True):
            low = visible(t)
            whole = {fold(w) for w in _WORD.findall(low)}
            found.update((w, False, y) for w in whole if len(w) > 2)
            found.update({(w[:n], True, y) for w in whole for n in STEM_LENGTHS if len(w) > n})
            found[None, False, y] += 1
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows]), pa.array([k[2] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], schema=schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60) -> tuple[float, ...]:
    """Newton's method with a small ridge; classes weigh alike."""
    X = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(X.shape[1])
    share = y.mean()
    sample = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (sample * (p - y)) + l2 * np.r_[0, w[1:]] * 0.1
        h = (X * (sample * p * (1 - p) + 1e-9)[:, None]).T @ X + l2 * 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def train(spark: SparkSession, labels: DataFrame, docs: DataFrame, *, max_rows: int = 20_000, min_documents: int = 4, min_share: float = 0.8) -> Lexicon:
    """Learn from ``labels`` (doc_id, toxic 0/1) and the texts of ``docs`` (doc_id, text). At most max_rows labels,
    those with the smallest hash of doc_id, are used, and every word or stem of them that tells; their number is bounded
    by that of the labels, as each needs min_documents toxic ones."""
    bound_batches(spark)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    sample = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    counted = rows.mapInArrow(_terms, "term string, stem boolean, toxic int, n long").groupBy("term", "stem").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")).persist()
    size = counted.where("term is null").first()
    if size is None or not size["bad"] or not size["good"]:
        counted.unpersist()
        return Lexicon(dict.fromkeys(map(fold, SEEDS), SEED_WEIGHT), {})
    bad, good = size["bad"], size["good"]
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    share = (F.col("bad") / bad) / (F.col("bad") / bad + F.col("good") / good)
    top = counted.where("term is not null").where((F.col("bad") >= min_documents) & (share >= min_share)).withColumn("odds", odds).where("odds >= 2.5").orderBy(F.desc("odds"), "term", "stem").collect()
    counted.unpersist()
    words = dict.fromkeys(map(fold, SEEDS), SEED_WEIGHT)
    stems: dict[str, float] = {}
    whole = {r["term"]: r["bad"] for r in top if not r["stem"]}
    for r in top:
        if r["stem"]:  # a stem is for several words; that of one word alone would catch its harmless neighbours
            if r["bad"] >= 1.25 * max([0, *(n for w, n in whole.items() if w.startswith(r["term"]))]):
                stems[r["term"]] = float(r["odds"])
        else:
            words[r["term"]] = max(float(r["odds"]), words.get(r["term"], 0.0))
    lexicon = Lexicon(words, stems)
    seen = rows.select("doc_id", "text", F.col("toxic").alias("truth")).mapInArrow(_hits(lexicon, "truth"), "doc_id long, weight double, hits long, n_words long, truth int").toPandas()
    x = np.array([features(t, n) for t, n in zip(seen["weight"], seen["n_words"], strict=True)])
    lexicon.coefficients = fit_logistic(x, seen["truth"].to_numpy(float))
    return lexicon


def _hits(lexicon: Lexicon, keep: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols = list(zip(*[lexicon.hits(t) for t in texts(batch)], strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.float64(), pa.int64(), pa.int64()), strict=True)), batch.column(keep)], names=["doc_id", "weight", "hits", "n_words", keep])

    return run


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, hits of every row; nothing but doc_id and text is read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [lexicon.hits(t) for t in texts(batch)]
            s = [logistic(lexicon.coefficients, features(w, n)) for w, _, n in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32()), pa.array([h for _, h, _ in found], pa.int64())], names=["doc_id", "score", "predicted", "hits"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, hits long")
