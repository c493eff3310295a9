"""Quality rules: base counts, and the Jensen-Shannon distance of a document to its language's references.

A language's references are counted over all of its documents: the median share of each character class (letters,
digits, white space, punctuation, symbols, ...; beyond ASCII by Unicode category), which junk cannot move until it is half of the documents, and the
shares of its most frequent words plus one share for the rest.
A document's distances (base 2, 0 to 1) to them are judged only from a minimum length on; short texts pass.

Defined results: a null or empty text has counts of 0 and fails the base rule (fewer than 20 words); a null or
unknown language is compared with the nearest reference; repeated rows are judged alike; an empty table gives
an empty result; extra columns are passed through untouched by ``keep_good`` and ignored by ``judge``.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilescape.llm.common import Scratch, bound_batches, raw

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Flush a partition's word counts to Spark beyond so many different words, so that memory stays bounded.
HELD_WORDS = 200_000
#: Character classes of the histogram; letters beyond ASCII are a class of their own.
CLASSES = ("lower", "upper", "digit", "white", "stop", "quote", "symbol", "other", "letter")


def _classes() -> np.ndarray:
    """Of every code point below 0x20000; those above are as the plane's last, other."""
    by_category = {"L": "letter", "M": "letter", "N": "digit", "Z": "white", "Po": "stop", "P": "quote", "S": "symbol"}
    kinds = [unicodedata.category(chr(c)) for c in range(0x20000)]
    table = np.array([CLASSES.index(by_category.get(k, by_category.get(k[0], "other"))) for k in kinds])
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("white", b" \t\n\x0b\x0c\r"), ("stop", b".,;:?!"), ("quote", b"'\"()-_/"), ("symbol", b"#*$%&|<>=+~^\\{}[]@`")):
        table[list(members)] = CLASSES.index(name)
    return table


_CLASS = _classes()
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_WHITE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_POINT = ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))
SALTS = 64
#: Languages whose references are collected and broadcast together.
GROUP = 256
#: Groups of references that a process keeps; of more it loads one at a time.
HELD_GROUPS = 8
#: Steps of a share of a byte class when documents are counted by it.
STEPS = 200
_POWERS = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) for j in range(WINDOW)], np.uint64)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the verdict."""

    common_words: int = 64
    min_chars: int = 200
    max_char_distance: float = 0.31
    min_words: int = 50
    max_word_distance: float = 0.44
    min_base_words: int = 20
    max_repeat_percent: int = 30


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def class_counts(text: bytes, counts: np.ndarray) -> np.ndarray:
    """Characters of every class, from a text and its byte counts."""
    out = np.bincount(_CLASS[:128], weights=counts[:128], minlength=len(CLASSES))
    if counts[128:].any():
        points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        points = points[points >= 128]
        ideographs = (points >= 0x20000) & (points < 0x40000)
        out = out + np.bincount(_CLASS[np.minimum(points, 0x1FFFF)], minlength=len(CLASSES))
        out[CLASSES.index("letter")] += ideographs.sum()
        out[_CLASS[0x1FFFF]] -= ideographs.sum()
    return out


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in an 8-word window that occurs at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        acc += h[j : n + j] * _POWERS[j]
    order = np.sort(acc)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = np.unique(twice)
    at = np.searchsorted(twice, acc)
    hit = twice[np.minimum(at, len(twice) - 1)] == acc
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms of counts or shares."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def part(a: np.ndarray) -> float:
        on = a > 0
        return float((a[on] * np.log2(a[on] / m[on])).sum())

    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


@dataclass
class Reference:
    chars: np.ndarray
    words: dict[bytes, int]
    shares: np.ndarray


class References(Mapping):
    """The references of all languages, broadcast in groups of neighbouring languages."""

    def __init__(self, groups: list[Broadcast], starts: list[str], sizes: list[int]) -> None:
        self.groups, self.starts, self.sizes = groups, starts, sizes
        self._at, self._open = -1, {}

    def __getstate__(self) -> dict:
        return vars(self) | {"_at": -1, "_open": {}}

    def group(self, lang: str) -> int:
        """Number of the group that a language is in if it has references; -1 before the first."""
        return bisect_right(self.starts, lang) - 1

    def _load(self, at: int) -> dict[str, Reference]:
        if at != self._at:
            if self._at >= 0 and len(self.groups) > HELD_GROUPS:
                vars(self.groups[self._at]).pop("_value", None)
            self._open = self.groups[at].value
            self._at = at
        return self._open

    def __getitem__(self, lang: str) -> Reference:
        at = -1 if lang is None else self.group(lang)
        if at < 0:
            raise KeyError(lang)
        return self._load(at)[lang]

    def __iter__(self) -> Iterator[str]:
        for at in range(len(self.groups)):
            yield from list(self._load(at))

    def __len__(self) -> int:
        return sum(self.sizes)


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("key", pa.binary()), ("n", pa.int64())])
    words: dict[str, Counter] = defaultdict(Counter)
    chars: Counter = Counter()
    totals: Counter = Counter()

    def out(kind: int, rows: list[tuple[str, bytes, int]]) -> pa.RecordBatch:
        lang, key, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(lang), pa.array([kind] * len(n), pa.int32()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], schema=schema)

    for batch in it:
        for lang, t in zip(batch.column("lang").to_pylist(), raw(batch), strict=True):
            if lang is None or not t:
                continue
            split = t.lower().split()
            words[lang].update(split)
            totals[lang] += len(split)
            c = class_counts(t, byte_counts(t))
            chars.update((lang, k, b) for k, b in enumerate(np.rint(STEPS * c / c.sum()).astype(int).tolist()))
        if sum(map(len, words.values())) > HELD_WORDS:
            for lang, c in words.items():
                if c:
                    yield out(1, [(lang, w, n) for w, n in c.items()])
            words.clear()
    for lang, c in words.items():
        if c:
            yield out(1, [(lang, w, n) for w, n in c.items()])
    if chars:
        yield out(0, [(lang, bytes([k, b]), n) for (lang, k, b), n in chars.items()])
    if totals:
        yield out(2, [(lang, b"", n) for lang, n in totals.items()])


def references(spark: SparkSession, docs: DataFrame, rules: Rules = Rules()) -> References:
    """The references of every language, counted over all documents. They come to the driver GROUP languages at a time,
    each with at most common_words + len(CLASSES) * (STEPS + 1) + 1 numbers, whatever the corpus."""
    bound_batches(spark)
    counted = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_counts, "lang string, kind int, key binary, n long")
    summed = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # first the best of each of SALTS parts of a language, then of those: what one task gets has a bound that no corpus moves.
    # One rank limit for all, so that each task ranks its own best first and passes no more than those on
    limit = max(rules.common_words, STEPS + 1)
    group = ["lang", "kind", F.when(F.col("kind") == 0, F.substring("key", 1, 1))]
    rank = lambda *more: F.row_number().over(Window.partitionBy(*group, *more).orderBy(F.desc("n"), "key"))
    salted = summed.withColumn("r", rank(F.pmod(F.xxhash64("key"), F.lit(SALTS)))).where(F.col("r") <= limit)
    ranked = salted.withColumn("r", rank()).where(F.col("r") <= limit)
    scratch = Scratch(spark, "references")
    top = scratch.table(ranked.where((F.col("kind") != 1) | (F.col("r") <= rules.common_words)).drop("r"), "top")
    totals_of = {r["lang"]: int(r["n"]) for r in top.where("kind = 2 and n > 0").select("lang", "n").collect()}
    langs = sorted(totals_of)
    parts = [langs[i : i + GROUP] for i in range(0, len(langs), GROUP)]
    groups = []
    for part in parts:
        rows = defaultdict(list)
        for r in top.where(F.col("lang").between(part[0], part[-1])).collect():
            rows[r["lang"], r["kind"]].append((bytes(r["key"]), int(r["n"])))
        groups.append(spark.sparkContext.broadcast({lang: _reference(rows[lang, 0], rows[lang, 1], totals_of[lang]) for lang in part}))
    scratch.drop("top")
    return References(groups, [p[0] for p in parts], [len(p) for p in parts])


def _reference(classes: list[tuple[bytes, int]], words: list[tuple[bytes, int]], total: int) -> Reference:
    bins = np.zeros((len(CLASSES), STEPS + 1), np.int64)
    for key, n in classes:
        bins[key[0], key[1]] = n
    upto = bins.cumsum(axis=1)
    chars = (2 * upto >= upto[:, -1:]).argmax(axis=1).astype(float)
    chars = chars if chars.sum() else np.ones(len(CLASSES))
    common = sorted(words, key=lambda x: (-x[1], x[0]))
    shares = np.array([n for _, n in common] + [total - sum(n for _, n in common)], float)
    return Reference(chars, {w: i for i, (w, _) in enumerate(common)}, shares)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def judge_text(text: bytes | None, lang: str | None, refs: Mapping[str, Reference], rules: Rules) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept."""
    text = text or b""
    words = text.split()
    counts = byte_counts(text)
    points, white = int(counts[_POINT].sum()), int(counts[_WHITE].sum())
    again = repeated_words(words)
    failed = len(words) < rules.min_base_words or 100 * again > rules.max_repeat_percent * len(words)
    by_char = by_word = None
    long, wordy = points >= rules.min_chars, len(words) >= rules.min_words
    if long or wordy:
        own = refs.get(lang)
        c = class_counts(text, counts)
        seen = Counter(text.lower().split()) if wordy else Counter()
        # one reference at a time, as those of all languages need not fit
        for r in (own,) if own else refs.values():
            if long:
                d = distance(c, r.chars)
                by_char = d if by_char is None else min(by_char, d)
            if wordy:
                h = np.zeros(len(r.shares))
                for w, i in r.words.items():
                    h[i] = seen.get(w, 0)
                h[-1] = len(words) - h.sum()
                d = distance(h, r.shares)
                by_word = d if by_word is None else min(by_word, d)
    bad = (by_char is not None and by_char > rules.max_char_distance) or (by_word is not None and by_word > rules.max_word_distance)
    return len(words), points - white, int(counts[_SYMBOL].sum()), repeated_lines(text), again, failed, by_char, by_word, not (failed or bad)


def _judged(batch: pa.RecordBatch, langs: list[str | None], refs: Mapping[str, Reference], rules: Rules) -> list[tuple]:
    """judge_text of every row; rows of the same group of languages after each other, so that it is loaded once."""
    rows, out = raw(batch), [()] * batch.num_rows
    order = range(len(rows))
    if isinstance(refs, References) and len(refs.groups) > HELD_GROUPS:
        order = sorted(order, key=lambda i: -1 if langs[i] is None else refs.group(langs[i]))
    for i in order:
        out[i] = judge_text(rows[i], langs[i], refs, rules)
    return out


def judge(spark: SparkSession, docs: DataFrame, rules: Rules = Rules(), refs: Mapping[str, Reference] | None = None) -> DataFrame:
    """One row of counts, distances and verdict for every row of ``docs`` (doc_id, text, lang)."""
    bound_batches(spark)
    refs = references(spark, docs, rules) if refs is None else refs
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = _judged(batch, batch.column("lang").to_pylist(), refs, rules)
            cols = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep, with all their columns."""
    bound_batches(spark)
    refs = references(spark, docs, rules)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            langs = batch.column("lang").cast(pa.string()).to_pylist()
            yield batch.filter(pa.array([x[-1] for x in _judged(batch, langs, refs, rules)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
