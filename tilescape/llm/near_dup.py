"""MinHash near-duplicate detection with circulant permutations.

Shingles are hashed to a ring of ``UNIVERSE`` slots. A first permutation scatters the slots; a second one, shifted by
0, 1, 2, ... slots, gives every coordinate of the signature. The ranks under all shifts of a slot are neighbours in
one array, so a shingle's whole column of ranks is one contiguous read.

Steps:
1. documents with the same shingle set fall into one class (a digest of the sorted set), numbered in the order of
   their smallest doc_ids; copies never meet each other as pairs;
2. the signatures of the classes are cut into bands; equal bands make buckets;
3. in each bucket every member is compared with one centre (never with every other member), on full
   shingle sets; what is linked joins components;
4. classes of buckets that still hold several components are joined once more by an exact prefix filter, over
   shingles that several components have, so that no link is lost where the centre of a bucket was the wrong one to
   ask; shingles of one component alone, however large, are dropped before the join;
5. components come from min-label propagation with pointer jumping over tables in the shared folder.

Defined results: a null or wordless text has an empty set, links with nothing and is kept; texts of fewer
words than a shingle have one shingle, the whole sequence; every row is judged by its own text, so rows that repeat a
doc_id may be in different components; a null doc_id links like any other, but is no component's smallest id unless
all ids of the component are null; then component_id is null, and the rows are kept; ids are any 64-bit numbers;
extra columns are ignored by ``near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.llm.common import Scratch, bound_batches, raw

UNIVERSE = 1 << 21
BANDS = 32
#: Chance to miss a pair that is just as similar as the threshold.
MISS = 1e-7
#: Shingles of one verification block; a block holds a centre and some of its members.
BLOCK_SHINGLES = 1 << 17
#: Counters of shingle frequencies.
SLOT_BITS = 18

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def rows_per_band(percent: int, bands: int = BANDS) -> int:
    """The longest band whose chance to miss a pair at the threshold stays below MISS."""
    best = 1
    for r in range(1, 17):
        if (1 - (percent / 100) ** r) ** bands <= MISS:
            best = r
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < width:
        return _mixed((h * _ODD[: len(h)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(h)))
    acc = np.zeros(len(h) - width + 1, np.uint64)
    for j in range(width):
        acc += h[j : len(h) - width + 1 + j] * _ODD[j]
    return np.unique(_mixed(acc))


@lru_cache(maxsize=1)
def _first() -> np.ndarray:
    """The first permutation of the slots."""
    return np.random.Generator(np.random.PCG64(19530101)).permutation(UNIVERSE).astype(np.int32)


@lru_cache(maxsize=2)
def _ring(coordinates: int) -> np.ndarray:
    """Row s: the ranks of slot s under the permutation shifted by 0 .. coordinates-1."""
    pi = np.random.Generator(np.random.PCG64(20240229)).permutation(UNIVERSE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)


def signature(hashed: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set of hashes, whose top bits name their slots."""
    ring, first = _ring(coordinates), _first()
    slots = first[(hashed >> np.uint64(64 - 21)).astype(np.int64)]
    out = np.full(coordinates, UNIVERSE, np.uint32)
    for at in range(0, len(slots), 4096):
        np.minimum(out, ring[slots[at : at + 4096]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    part = sig.reshape(bands, -1).astype(np.uint64)
    acc = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(part.shape[1]):
        acc = _mixed(acc + part[:, j] + np.uint64(1))
    return acc.view(np.int64)


def _sketch(width: int, bands: int, rows: int, carry: tuple[str, ...]):
    names = ["doc_id", "n_shingles", "digest", "bands", *carry]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, digests, keys = [], [], []
            for t in raw(batch):
                s = shingles(t, width)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(signature(s, bands * rows), bands) if len(s) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *(batch.column(c) for c in carry)], names=names)

    return run


def _full_sets(width: int):
    schema = pa.schema([("digest", pa.binary()), ("set", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [s.tobytes() for t in raw(batch) if len(s := shingles(t, width))]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _sets(docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """digest, set of ``classes`` (low), and of other classes with documents of the same ids."""
    lows = classes.select(F.col("low").alias("_low")).distinct()
    rows = docs.join(lows, F.col("doc_id").eqNullSafe(F.col("_low")), "left_semi").select("text")
    return rows.mapInArrow(_full_sets(width), "digest binary, set binary").dropDuplicates(["digest"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    import pandas as pd

    def run(block: pd.DataFrame) -> pd.DataFrame:
        """A centre (the row whose node is the centre's) against the other rows of its block."""
        centre = int(block["centre"].iloc[0])
        mine = block.loc[block["node"] == centre, "set"]
        out = []
        if len(mine):
            c = np.frombuffer(mine.iloc[0], np.uint64)
            out = [u for u, s in zip(block["node"], block["set"], strict=True) if u != centre and similar(c, np.frombuffer(s, np.uint64), percent)]
        return pd.DataFrame({"a": np.full(len(out), centre, np.int64), "b": np.array(out, np.int64)})

    return run


def connected(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b); only nodes with an edge appear."""
    both = scratch.table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{tag}-edges")
    labels = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{tag}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = met.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        moved = scratch.table(hop.select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), f"{tag}-{step}")
        labels = moved.drop("old")
        scratch.drop(f"{tag}-{step - 1}")
        if moved.where("label != old").isEmpty():
            scratch.drop(f"{tag}-edges")
            return labels


def _tested(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int, percent: int, scratch: Scratch, tag: str) -> DataFrame:
    """Those of the pairs (centre, node) that are similar on full sets, as edges (a, b)."""
    u, c = reps.select("node", F.col("n_shingles").alias("nu")), reps.select(F.col("node").alias("centre"), F.col("n_shingles").alias("nc"))
    fit = pairs.join(u, "node").join(c, "centre").where(100 * F.least("nu", "nc") >= percent * F.greatest("nu", "nc"))
    fit = scratch.table(fit.select("centre", "node", "nu"), f"{tag}-pairs")
    blocks = fit.groupBy("centre").agg(F.ceil(F.sum("nu") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = fit.join(blocks, "centre").select("centre", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    centres = members.select("centre", F.col("centre").alias("node"), "block").distinct()
    wanted = scratch.table(members.union(centres).join(reps.select("node", "low", "digest"), "node"), f"{tag}-wanted")
    sets = _sets(docs, wanted, width)
    edges = wanted.select("centre", "node", "block", "digest").join(sets, "digest").drop("digest").groupBy("centre", "block").applyInPandas(_verify(percent), "a long, b long")
    edges = scratch.table(edges, f"{tag}-edges")
    scratch.drop(f"{tag}-pairs", f"{tag}-wanted")
    return edges


def _slots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in it:
        for t in batch.column("set").to_pylist():
            counts += np.bincount((np.frombuffer(t, np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])


def _prefixes(percent: int, frequency: np.ndarray):
    """Of each set the shingles that a partner must share one of, rare ones first: (token, node, label, n, pos)."""
    names = ["token", "node", "label", "n", "pos"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols: list[list] = [[] for _ in names]
            for doc, label, t in zip(*(batch.column(c).to_pylist() for c in ("node", "label", "set")), strict=True):
                s = np.frombuffer(t, np.uint64)
                n = len(s)
                keep = n - -(-percent * n // 100) + 1
                order = np.lexsort((s, frequency[(s >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))[:keep]
                for col, v in zip(cols, (s[order].view(np.int64), np.full(keep, doc), np.full(keep, label), np.full(keep, n), np.arange(keep)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in cols], names=names)

    return run


def _compare(percent: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sets]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _missed(docs: DataFrame, open_nodes: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links between different components of open_nodes (node, label, low, digest), found by an exact prefix-filter join.

    Two linked sets share one of their first shingles in any common order. Ordered by rarity (counts in a
    fixed number of slots), shingles that a whole group shares come last. Shingles of one component alone are dropped;
    of the rest, Spark's skew join splits the frequent ones, and the bound on what can still overlap drops
    most pairs inside the join.
    """
    sets = scratch.table(_sets(docs, open_nodes, width).join(open_nodes.drop("low"), "digest").drop("digest"), "open-sets")
    counted = sets.select("set").mapInArrow(_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << SLOT_BITS, np.int64)
    frequency[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    firsts = scratch.table(sets.mapInArrow(_prefixes(percent, frequency), "token long, node long, label long, n long, pos long"), "prefixes")
    met = scratch.table(firsts.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token"), "met")
    firsts = scratch.table(firsts.join(met, "token", "left_semi"), "meeting")
    x = firsts.select("token", *(F.col(c).alias(f"{c}_x") for c in ("node", "label", "n", "pos")))
    y = firsts.select("token", *(F.col(c).alias(f"{c}_y") for c in ("node", "label", "n", "pos")))
    need = f"({percent} * (n_x + n_y) + {99 + percent}) div {100 + percent}"
    fits = F.expr(
        "label_x != label_y and (n_x < n_y or (n_x = n_y and node_x < node_y))"
        f" and 100 * n_x >= {percent} * n_y"
        f" and pos_x <= n_x - ({2 * percent} * n_x + {99 + percent}) div {100 + percent}"
        f" and 1 + least(n_x - pos_x - 1, n_y - pos_y - 1) >= {need}"
    )
    pairs = x.join(y, (x["token"] == y["token"]) & fits).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    found = scratch.table(both.select("a", "b", "x", "y").mapInArrow(_compare(percent), "a long, b long"), "missed")
    scratch.drop("open-sets", "prefixes", "met", "meeting")
    return found


def near_duplicates(spark: SparkSession, docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, group and ``carry`` for every row of ``docs`` (doc_id, text).

    Documents are linked when 100 * intersection >= percent * union of their sets of ``width``-word shingles;
    component_id is the smallest doc_id reachable over links, and the document with that id is kept. group numbers the
    components of this run, which repeated ids may not tell apart; it is null for empty sets.
    """
    bound_batches(spark)
    scratch = Scratch(spark, "near_dup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    ddl = ", ".join(["doc_id long, n_shingles long, digest binary, bands array<long>", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carry)])
    sketches = scratch.table(docs.mapInArrow(_sketch(width, bands, rows_per_band(percent, bands), carry), ddl), "sketches")
    classes = sketches.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    # numbered in the order of their smallest ids: first come the originals, which are the best centres for their copies
    ordered = classes.repartitionByRange("low", "digest").sortWithinPartitions("low", "digest")
    reps = scratch.table(ordered.withColumn("node", F.monotonically_increasing_id()), "classes")
    spread = reps.select("node", F.explode("bands").alias("key"))
    shared = scratch.table(spread.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre"), "shared")
    members = scratch.table(spread.join(shared, "key").select("key", "centre", "node"), "members")
    pairs = members.where("node != centre").select("centre", "node").distinct()
    edges = _tested(docs, pairs, reps, width, percent, scratch, "r0")
    labels = connected(spark, edges, scratch, "cc0")
    named = scratch.table(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "named")
    mixed = scratch.table(named.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("key"), "mixed")
    open_nodes = named.join(mixed, "key", "left_semi").select("node", "label").distinct().join(reps.select("node", "low", "digest"), "node")
    more = _missed(docs, scratch.table(open_nodes, "open"), width, percent, scratch)
    if not more.isEmpty():
        labels = connected(spark, edges.union(more), scratch, "cc1")
    linked = labels.join(reps.select("node", "low"), "node")
    component = linked.select("node", "label").join(linked.groupBy("label").agg(F.min("low").alias("component")), "label")
    of = reps.select("digest", "low", "node").join(component, "node", "left").select("digest", F.when(F.col("label").isNull(), F.col("low")).otherwise(F.col("component")).alias("component"), F.coalesce("label", "node").alias("group"))
    out = sketches.drop("bands").join(of, "digest", "left")
    smallest = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", smallest.alias("component_id"), F.col("doc_id").eqNullSafe(smallest).alias("kept"), "group", *carry)
