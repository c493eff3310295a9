"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to k = rate * m edits. Cut into k + 1 pieces, at
least one piece then occurs unchanged, so an automaton over all pieces finds every place worth a look. A q-gram
count rules out most chance hits (an occurrence keeps at least m + 1 - q - k * q of the item's q-grams; where a document
has pieces of many items, as of a template, those of one region are counted together in its shorter grams), and
Myers' bit-parallel distance decides the rest. Texts are compared lower-cased, with white space runs as one space.

Items shorter than ``min_chars`` are searched for with the same budget, but count only where they begin and end at
the bounds of words; those whose few words any text may hold by chance (see ``telling``) are left out.

Defined results: null or empty texts match nothing; items that are null or do not tell are not searched for; repeated items are found under each item_id; repeated documents are reported or removed alike; an
empty benchmark removes nothing; extra columns pass through ``without_leaks`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.llm.common import batches, bound_batches, texts

#: Characters of items that one automaton holds; a larger benchmark is searched in several passes.
SHARD_CHARS = 8_000_000
Q = 5
#: Length of the grams that many items are counted in.
SHORT_Q = 3
#: Items with pieces in a text up to which each is tried for itself.
FEW = 16
#: Scripts that write without spaces: characters that are words or large parts of them, and alphabets.
_IDEOGRAPHS = "\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff{_IDEOGRAPHS}]")
_IDEOGRAPH = re.compile(f"[{_IDEOGRAPHS}]")
_HANGUL = re.compile("[\uac00-\ud7a3]")
_WORD = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def telling(text: str) -> bool:
    """Whether an item's words are too many to stand in a text by chance: three different words of 12 letters and
    digits in all (a Hangul syllable is two), or 8 ideographs or kana, or 16 letters of another script without spaces."""
    words = _WORD.findall(text)
    if len(_IDEOGRAPH.findall(text)) >= 8 or len(_UNSPACED.findall(text)) >= 16:
        return True
    return len(set(words)) >= 3 and sum(map(len, words)) + len(_HANGUL.findall(text)) >= 12


def _parted(text: str, at: int) -> bool:
    """Whether a word may begin or end at a place of the text."""
    if not 0 < at < len(text):
        return True
    a, b = text[at - 1], text[at]
    return not (a.isalnum() and b.isalnum()) or bool(_UNSPACED.match(a) or _UNSPACED.match(b))


def at_bounds(pattern: str, text: str, k: int, low: int, high: int) -> tuple[int, int]:
    """(distance, end) of the best occurrence of a short pattern in text[low:high] that begins and ends at bounds of
    words, by the plain table from every start that is such a bound; a distance of k + 1 if there is none."""
    best = (k + 1, 0)
    high = min(high, len(text))
    for start in range(low, high):
        if not _parted(text, start):
            continue
        row = list(range(len(pattern) + 1))
        for end in range(start + 1, min(high, start + len(pattern) + k) + 1):
            c, above = text[end - 1], row[0]
            row[0] = end - start
            for j, p in enumerate(pattern, 1):
                above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (p != c))
            if row[-1] < best[0] and _parted(text, end):
                best = (row[-1], end)
            if min(row) >= best[0]:
                break
    return best


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of the k + 1 pieces."""
    at = [len(text) * j // (k + 1) for j in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(at, at[1:], strict=False)]


def myers(pattern: str, text: str, peq: dict[str, int] | None = None) -> tuple[int, int]:
    """(distance, end) of the best occurrence of the pattern in the text; the first end of several."""
    m = len(pattern)
    if peq is None:
        peq = positions(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, at
        ph <<= 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, end


def positions(pattern: str) -> dict[str, int]:
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    return dict(peq)


class Matcher:
    """The items of one shard, ready to search texts."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float, min_chars: int = 0) -> None:
        import ahocorasick

        self.min_chars = min_chars  # shorter items need bounds of words
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.items = []
        self.grams: dict[str, int] = {}
        numbers, ends = array("i"), array("q", [0])
        for n, (item, text) in enumerate(items):
            k = budget(len(text), rate)
            self.items.append((item, text, k))
            for i in range(len(text) - SHORT_Q + 1):
                numbers.append(self.grams.setdefault(text[i : i + SHORT_Q], len(self.grams)))
            ends.append(len(numbers))
            for offset, piece in pieces(text, k):
                found[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.empty = not found
        self.numbers, self.ends = np.frombuffer(numbers, np.int32) if numbers else np.empty(0, np.int32), np.frombuffer(ends, np.int64)
        self.lengths, self.budgets = np.array([len(text) for _, text, _ in self.items], np.int64), np.array([k for _, _, k in self.items], np.int64)
        if found:
            self.automaton.make_automaton()

    def _likely(self, text: str, starts: dict[int, list[int]]) -> Iterator[tuple[int, list[int]]]:
        """Of many items with pieces in a text those with enough grams in a region where they may begin."""
        item = np.repeat(np.fromiter(starts, np.int64, len(starts)), list(map(len, starts.values())))
        low = np.fromiter(chain.from_iterable(starts.values()), np.int64, len(item)) - self.budgets[item]
        high = low + self.lengths[item] + 3 * self.budgets[item]
        region = low >> 6
        order = np.lexsort((item, region))
        alive: set[int] = set()
        for mine in np.split(order, np.flatnonzero(np.diff(region[order])) + 1):
            window = text[max(0, int(low[mine].min())) : int(high[mine].max())]
            there = np.zeros(len(self.grams) + 1, bool)
            there[[self.grams.get(window[x : x + SHORT_Q], -1) for x in range(len(window) - SHORT_Q + 1)]] = True
            there[-1] = False
            each = np.unique(item[mine])
            size = self.ends[each + 1] - self.ends[each]
            upto = np.cumsum(size)
            found = np.append(0, np.cumsum(there[self.numbers[np.repeat(self.ends[each] - (upto - size), size) + np.arange(upto[-1])]], dtype=np.int64))
            total = found[upto] - found[upto - size]
            alive.update(each[total >= self.lengths[each] + 1 - SHORT_Q * (1 + self.budgets[each])].tolist())
        for n in sorted(alive):
            yield n, starts[n]

    def search(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item, distance, budget, end) of every item that occurs within its budget."""
        if self.empty or not text:
            return
        starts: dict[int, list[int]] = defaultdict(list)
        for last, (length, where) in self.automaton.iter(text):
            for n, offset in where:
                starts[n].append(last + 1 - length - offset)
        for n, at in starts.items() if len(starts) <= FEW else self._likely(text, starts):
            item, pattern, k = self.items[n]
            peq: dict[str, int] | None = None
            m, need = len(pattern), len(pattern) + 1 - Q - k * Q
            best = (k + 1, 0)
            at.sort()
            i = 0
            while i < len(at):
                j = i
                while j + 1 < len(at) and at[j + 1] - at[j] <= k:
                    j += 1
                low, high = max(0, at[i] - k), at[j] + m + k
                window = text[low:high]
                i = j + 1
                if need > 0:
                    there = {window[x : x + Q] for x in range(len(window) - Q + 1)}
                    if sum(pattern[x : x + Q] in there for x in range(m - Q + 1)) < need:
                        continue
                peq = peq or positions(pattern)
                d, end = myers(pattern, window, peq)
                end += low
                if m < self.min_chars and d < best[0]:
                    d, end = at_bounds(pattern, text, k, low, high)
                if d < best[0]:
                    best = (d, end)
            if best[0] <= k:
                yield item, best[0], k, best[1]


@lru_cache(maxsize=2)
def _matcher(key: str, items: tuple, rate: float, min_chars: int) -> Matcher:
    return Matcher(items, rate, min_chars)


def _shards(benchmark: DataFrame, min_chars: int) -> list[tuple[tuple[int, str], ...]]:
    """The items in shards of about SHARD_CHARS characters. A shard goes to the executors with the function that searches
    for it, and each is one more pass over the documents: a benchmark is small beside them."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = -(-total // SHARD_CHARS)
    for s in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == s).collect()
        ready = sorted((r["item_id"], normalised(r["text"])) for r in rows)
        if ready := tuple(x for x in ready if len(x[1]) >= min_chars or telling(x[1])):
            yield ready


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.10, min_chars: int = 24) -> DataFrame:
    """doc_id, item_id, distance, budget, end_at (in the normalised text): one row per document and item found in it."""
    bound_batches(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("end_at", pa.int64())])
    ddl = "doc_id long, item_id long, distance int, budget int, end_at long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shard in _shards(benchmark, min_chars):
        key = hashlib.sha256(repr(shard).encode()).hexdigest()

        def run(it: Iterator[pa.RecordBatch], shard=shard, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shard, rate, min_chars)
            rows = (
                {"doc_id": i, "item_id": item, "distance": d, "budget": k, "end_at": end}
                for batch in it
                for i, t in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True)
                for item, d, k, end in matcher.search(normalised(t))
            )
            yield from batches(rows, schema)

        found = docs.mapInArrow(run, ddl)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], ddl) if out is None else out


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, rate: float = 0.10, min_chars: int = 24) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns."""
    bound_batches(spark)
    for shard in _shards(benchmark, min_chars):
        key = hashlib.sha256(repr(shard).encode()).hexdigest()

        def run(it: Iterator[pa.RecordBatch], shard=shard, key=key) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shard, rate, min_chars)
            for batch in it:
                yield batch.filter(pa.array([next(matcher.search(normalised(t)), None) is None for t in texts(batch)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
