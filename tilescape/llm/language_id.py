"""Language identification with interpolated Kneser-Ney character models.

Each language has a model of order ``ORDER`` over folded text (lower case; everything but letters is one space).
An n-gram is packed into 64 bits, 12 for a character. A group of languages shares, for every order, one sorted
array of packed n-grams and a matrix of each language's interpolated log probability; n-grams no language has
seen back off through the sorted contexts and their weights. The language of the lowest cross-entropy per
character wins; it is rejected if its cross-entropy lies beyond what its own training texts reach.

Training uses whole texts of at most ``per_language`` documents of each language, those with the smallest hash (which
are looked for below a hash that as many documents and a few more are expected under). All
languages are learned, each by one task; the models are packed and broadcast in groups of at most GROUP languages and about
GROUP_GRAMS n-grams, and a batch of texts meets one group after the other, so that neither the driver nor a worker
holds more than HELD_GROUPS of them.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything if nothing can be
learned; ties go to the language first in code point order; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilescape.llm.common import Scratch, bound_batches, texts

ORDER = 4
BITS = 12
#: Languages that share one set of sorted arrays; more languages make more sets.
GROUP = 16
GROUP_GRAMS = 2_000_000
#: Groups that a process keeps between batches; of more it loads one at a time.
HELD_GROUPS = 4
#: Rows of one id or language and a few numbers that are broadcast; more meet the documents by a shuffle.
BROADCAST_IDS = 2_000_000
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def folded(text: str | None) -> np.ndarray:
    """12-bit character codes of the text between two spaces; empty if it has no letter."""
    if not text:
        return np.empty(0, np.uint64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(cp, 0xFFFF)
    is_letter = _letters()[low] | (cp > 0xFFFF)
    if not is_letter.any():
        return np.empty(0, np.uint64)
    code = np.where(cp < 0x800, cp, 0x800 + (cp * np.uint32(2654435761) >> np.uint32(21)) % np.uint32(0x800))
    code = np.where(is_letter, code, 32).astype(np.uint64)
    code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    return code[keep]


def grams(code: np.ndarray, order: int) -> np.ndarray:
    """Packed n-grams that end at every character after the first; the start is padded with spaces."""
    if len(code) < 2:
        return np.empty(0, np.uint64)
    padded = np.concatenate([np.full(order - 2, 32, np.uint64), code]) if order > 2 else code
    n = len(code) - 1
    out = np.zeros(n, np.uint64)
    for j in range(order):
        out = (out << np.uint64(BITS)) | padded[len(padded) - n - order + 1 + j : len(padded) - order + 1 + j]
    return out


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << (BITS * order)) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


def _discount(counts: np.ndarray) -> float:
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def kneser_ney(types: np.ndarray, counts: np.ndarray, alphabet: int) -> list[tuple]:
    """Per order 1 .. ORDER: sorted n-grams, their interpolated probabilities, sorted contexts, back-off weights."""
    by_order = {ORDER: (types, counts.astype(float))}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different characters precede
        g, n = np.unique(by_order[k + 1][0] & _mask(k), return_counts=True)
        by_order[k] = (g, n.astype(float))
    out: list[tuple] = []
    for k in range(1, ORDER + 1):
        g, n = by_order[k]
        d = _discount(n)
        ctx, inverse, followers = np.unique(g >> np.uint64(BITS), return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=n)
        weight = d * followers / total
        if k == 1:
            lower = np.full(len(g), 1 / alphabet)
        else:
            at, _ = _find(out[-1][0], g & _mask(k - 1))
            lower = out[-1][1][at]
        out.append((g, np.maximum(n - d, 0) / total[inverse] + weight[inverse] * lower, ctx, weight))
    return out


@dataclass
class Models:
    """Sorted arrays and log2 probability matrices of a group of languages."""

    langs: list[str]
    tables: list[tuple]  # per order: n-grams, log2 p [n-gram, language], contexts, log2 weight [context, language]
    floor: float

    def log2(self, g: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 0:
            return np.full((len(g), len(self.langs)), self.floor, np.float32)
        keys, p, ctx, weight = self.tables[order - 1]
        at, hit = _find(keys, g)
        if hit.all():
            return p[at]
        out = np.empty((len(g), len(self.langs)), np.float32)
        out[hit] = p[at[hit]]
        miss = g[~hit]
        back = self.log2(miss & _mask(order - 1), order - 1)
        at, seen = _find(ctx, miss >> np.uint64(BITS))
        back[seen] += weight[at[seen]]
        out[~hit] = back
        return out

    def entropy(self, code: np.ndarray) -> np.ndarray:
        g = grams(code, ORDER)
        total = np.zeros(len(self.langs))
        for at in range(0, len(g), 1 << 16):
            total -= self.log2(g[at : at + (1 << 16)]).sum(axis=0, dtype=np.float64)
        return total / max(1, len(g))


def group_models(per_lang: dict[str, list[tuple]], alphabet: int) -> Models:
    langs = sorted(per_lang)
    floor = float(np.log2(1 / alphabet))
    models = Models(langs, [], floor)
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([per_lang[x][k - 1][0] for x in langs]))
        ctx = np.unique(np.concatenate([per_lang[x][k - 1][2] for x in langs]))
        weight = np.zeros((len(ctx), len(langs)), np.float32)  # an unseen context passes its whole mass on
        for j, x in enumerate(langs):
            at, hit = _find(per_lang[x][k - 1][2], ctx)
            weight[hit, j] = np.log2(per_lang[x][k - 1][3][at[hit]])
        lower = models.log2(keys & _mask(k - 1), k - 1) if k > 1 else np.full((len(keys), len(langs)), floor, np.float32)
        at, seen = _find(ctx, keys >> np.uint64(BITS))
        p = lower + np.where(seen[:, None], weight[at], 0).astype(np.float32)
        for j, x in enumerate(langs):
            at, hit = _find(per_lang[x][k - 1][0], keys)
            p[hit, j] = np.log2(per_lang[x][k - 1][1][at[hit]])
        models.tables.append((keys, p, ctx, weight))
    return models


@dataclass
class Identifier:
    groups: list[Broadcast]  # of Models
    limits: dict[str, float]

    def __call__(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """language, score, cross-entropy in bits a character, rejected."""
        return self.judge([text])[0]

    def judge(self, batch: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        codes = [folded(t) for t in batch]
        langs: list[str] = []
        entropies: list[list[np.ndarray]] = [[] for _ in codes]
        for held in self.groups if any(map(len, codes)) else []:
            models = held.value
            langs += models.langs
            for code, found in zip(codes, entropies, strict=True):
                if len(code):
                    found.append(models.entropy(code))
            del models
            if len(self.groups) > HELD_GROUPS:
                vars(held).pop("_value", None)  # the process' copy; the next batch loads it anew
        return [self._verdict(len(code), found, langs) for code, found in zip(codes, entropies, strict=True)]

    def _verdict(self, length: int, entropies: list[np.ndarray], langs: list[str]) -> tuple[str, float, float | None, bool]:
        if not entropies:
            return UNDETERMINED, 0.0, None, True
        bits = np.concatenate(entropies)
        best = int(np.argmin(bits))
        weight = np.exp2(-(bits - bits[best]) * min(length, 64))
        beyond = bits[best] - self.limits.get(langs[best], np.inf)
        score = float(1 / weight.sum()) * (float(np.exp2(-beyond)) if beyond > 0 else 1.0)
        return langs[best], min(1.0, max(0.0, score)), float(bits[best]), bool(beyond > 0)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in it:
        found = defaultdict(list)
        for lang, t in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
            found[lang].append(grams(folded(t), ORDER))
        for lang, parts in found.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)


MODEL = "lang string, k int, context boolean, key long, value double"


def _model(alphabet: int):
    """The model of one language, from its n-gram counts: rows of MODEL."""

    def run(table: pa.Table) -> pa.Table:
        gram, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(gram)
        parts = []
        for k, (g, p, ctx, weight) in enumerate(kneser_ney(gram[order], n[order], alphabet), 1):
            for is_context, keys, values in ((False, g, p), (True, ctx, weight)):
                rows = [pa.repeat(table.column("lang")[0], len(keys)), pa.array(np.full(len(keys), k, np.int32)), pa.array(np.full(len(keys), is_context)), pa.array(keys.view(np.int64)), pa.array(values)]
                parts.append(pa.Table.from_arrays(rows, names=["lang", "k", "context", "key", "value"]))
        return pa.concat_tables(parts)

    return run


def _of_languages(table: pa.Table, langs: list[str]) -> dict[str, list[tuple]]:
    """kneser_ney's form of each language, from rows of MODEL."""
    code = pc.index_in(table.column("lang"), value_set=pa.array(langs)).to_numpy()
    k, context, key, value = table.column("k").to_numpy(), table.column("context").to_numpy(), table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
    place = (code.astype(np.int64) * ORDER + k - 1) * 2 + context
    order = np.lexsort((key, place))
    ends = np.searchsorted(place[order], np.arange(len(langs) * ORDER * 2 + 1))
    cut = lambda i: order[ends[i] : ends[i + 1]]
    out = {}
    for i, lang in enumerate(langs):
        out[lang] = [(key[g], value[g], key[c], value[c]) for g, c in ((cut((i * ORDER + j) * 2), cut((i * ORDER + j) * 2 + 1)) for j in range(ORDER))]
    return out


def grouped(sizes: dict[str, int]) -> list[list[str]]:
    """Languages in order, in groups of at most GROUP of them and about GROUP_GRAMS n-grams."""
    out: list[list[str]] = []
    held = 0
    for lang in sorted(sizes):
        if not out or len(out[-1]) == GROUP or held + sizes[lang] > GROUP_GRAMS:
            out.append([])
            held = 0
        out[-1].append(lang)
        held += sizes[lang]
    return out


def train(spark: SparkSession, labelled: DataFrame, *, per_language: int = 500, slack: float = 0.3) -> Identifier:
    """Learn from ``labelled`` (doc_id, text, lang): every language, and of each at most per_language texts. Their
    n-grams, which do not grow with a language's documents, come to the driver a group of languages at a time."""
    bound_batches(spark)
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    scratch = Scratch(spark, "languages")
    sizes = scratch.table(labelled.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))  # of the hash in 0 .. 1
    enough = per_language + 8 * per_language**0.5 + 20
    near = labelled.select("doc_id", "lang", place.alias("place")).join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, "lang").where(F.col("place") * F.col("n") <= enough)
    first = Window.partitionBy("lang").orderBy("place", "doc_id")
    chosen = scratch.table(near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("doc_id").distinct(), "chosen")
    sample = labelled.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen, "doc_id", "left_semi").persist()
    counts = scratch.table(sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    per = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    alphabet = 1 + counts.select(F.col("gram").bitwiseAND(F.lit(int(_mask(1))))).distinct().count()
    models = scratch.table(counts.groupBy("lang").applyInArrow(_model(alphabet), MODEL), "models")
    groups = []
    for langs in grouped(per):
        found = _of_languages(models.where(F.col("lang").between(langs[0], langs[-1])).toArrow(), langs)
        groups.append(spark.sparkContext.broadcast(group_models(found, alphabet)))
    own = identify(sample.select("doc_id", "text", F.col("lang").alias("truth")), Identifier(groups, {}), keep="truth")
    reach = own.where("bits is not null and lang_pred = truth").groupBy("truth").agg(F.percentile("bits", F.lit(0.999)).alias("bits")).collect()
    sample.unpersist()
    scratch.drop("chosen", "counts", "sizes", "models")
    return Identifier(groups, {r["truth"]: r["bits"] + slack for r in reach})


def identify(docs: DataFrame, model: Identifier, keep: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score, bits, rejected of every row; only doc_id and text are read (and ``keep``, passed on)."""
    names = ["doc_id", "lang_pred", "score", "bits", "rejected"]
    kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols = list(zip(*model.judge(texts(batch)), strict=True)) or [[]] * 4
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays + ([batch.column(keep)] if keep else []), names=names + ([keep] if keep else []))

    ddl = "doc_id long, lang_pred string, score double, bits double, rejected boolean" + (f", {keep} string" if keep else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([keep] if keep else [])).mapInArrow(run, ddl)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))
