"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, repeated for as many rounds as a document may be taken. A
copy's virtual finish time is the source's tokens up to and including it, divided by the source's target. The copies
of all sources are range-sorted by finish time, and the queue is cut where its words reach the total budget
(``cut="words"``: the copy there is taken for the words that remain; ``cut="whole"``: as a whole if at least half of it
fits). With ``cut="words"`` the one copy of a source that is being served at virtual time 1, when every source has had
its target, is queued in packets of at most a 1,024th of it, so that a long document does not throw a small source off.

The cumulative tokens are a two-level sum: documents hash into slots of their source, slot totals are summed
along the source, and only the documents of one slot are sorted together. A source with a third of all rows is
therefore spread over as many tasks as any other rows. The cut takes the sums of the range partitions, and a running
sum in the one partition that it falls into; every copy is then compared with the cut.

Defined results: a null text has size 0 and is never taken; a null source is a source, ordered last; repeated
doc_ids are ordered by size, then by ``carry``, equal ones arbitrarily among themselves; an empty table gives an empty
result; extra columns are ignored but for those named in ``carry``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilescape.llm.common import Scratch, n_words

#: Hex digits of the shuffle key that name a slot: 16 ** 3 slots in every source and round.
SLOT_DIGITS = 3
#: Packets of a copy that is queued in packets.
PACKETS = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, target, rank (0, 1, ... in the order of the sources), from (source, size) rows.

    Sources in code point order, null last, take the weights in turn. The budget is ``share`` times all sizes;
    a source's target stops at ``most`` times its size and the excess goes to the others by weight. Served in
    the order of size / weight, the capped sources are a prefix, so one pass finds the level of the rest. The
    windows here see one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    w = per.withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("w", F.element_at(F.array(*[F.lit(x).cast("long") for x in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    w = w.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything)).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(from_here))
    fits = F.col("w") * F.col("level") <= F.col("cap")  # from the first source that fits, all do
    w = w.withColumn("place", F.row_number().over(order)).withColumn("level", F.min_by("level", F.when(fits, F.col("place"))).over(everything))
    target = F.when(F.col("level").isNull() | (F.col("w") * F.col("level") > F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return w.select("source", "source_size", target.alias("target"), F.col("turn").alias("rank"))


def shuffle_key(seed: int, turn: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), F.col("doc_id").cast("string")))


def queued(scratch: Scratch, docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, source, size, source_size, target, rank and, for every round 0 .. most-1, start_<round>: the
    words of the source that are served before the copy."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, F.col("source").cast("string").alias("source"), n_words().alias("size"))
    sized = scratch.table(sized, "sized")
    per = scratch.table(targets(sized, weights, share, most), "targets")
    keyed = sized
    for turn in range(most):
        keyed = keyed.withColumn(f"key_{turn}", shuffle_key(seed, F.lit(turn)))
    out = keyed
    for turn in range(most):
        slot = F.substring(f"key_{turn}", 1, SLOT_DIGITS)
        out = out.withColumn("slot", slot)
        slots = keyed.withColumn("slot", slot).groupBy("source", "slot").agg(F.sum("size").alias("in_slot"))
        along = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        slots = slots.select(F.col("source").alias("s"), F.col("slot").alias("at"), F.coalesce(F.sum("in_slot").over(along), F.lit(0)).alias("before"))
        inside = Window.partitionBy("source", "slot").orderBy(f"key_{turn}", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        out = out.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("at")))
        out = out.withColumn(f"start_{turn}", F.col("before") + F.col("within")).drop("s", "at", "before", "within", "slot")
    out = out.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    starts = [(turn * F.col("source_size") + F.col(f"start_{turn}")).alias(f"start_{turn}") for turn in range(most)]
    return scratch.table(out.select("doc_id", *carry, "source", "size", "source_size", "target", "rank", *starts), "queued")


def packets(turn: int, cut: str) -> Column:
    """Array of (finish, words) that a copy is queued as; empty for a copy without words."""
    start, size = F.col(f"start_{turn}"), F.col("size")
    across = (start < F.col("target")) & (start + size > F.col("target")) if cut == "words" else F.lit(False)
    step = F.when(across, F.ceil(size / F.lit(PACKETS))).otherwise(size).cast("long")
    each = F.transform(F.sequence(F.lit(0).cast("long"), size - 1, step), lambda at: F.struct((start + F.least(at + step, size)).cast("double").alias("served"), F.least(step, size - at).alias("words")))
    finish = F.transform(each, lambda p: F.struct((p["served"] / F.col("target")).alias("finish"), p["words"].alias("words")))
    return F.when(size > 0, finish).otherwise(F.array().cast("array<struct<finish:double,words:bigint>>"))


def schedule(queue: DataFrame, most: int = 2, cut: str = "words") -> DataFrame:
    """The packets of all copies, range-sorted by finish time: finish, rank, words. Within a source no two finish at
    once, so that (finish, rank) is a total order."""
    both = queue.select("rank", F.explode(F.concat(*[packets(t, cut) for t in range(most)])).alias("p"))
    return both.select("p.finish", "rank", "p.words").repartitionByRange("finish", "rank")


def find_cut(scratch: Scratch, sorted_queue: DataFrame, budget: int) -> tuple[float, int, int, int] | None:
    """(finish, rank, words that fit, words) of the packet at which the queue reaches the budget; None if it never does."""
    parts = scratch.table(sorted_queue.withColumn("part", F.spark_partition_id()), "schedule")
    before = 0  # the sums of a few thousand partitions, in the order of their ranges
    for part, words in sorted((r["part"], r["words"]) for r in parts.groupBy("part").agg(F.sum("words").alias("words")).collect()):
        if before + words >= budget:
            running = F.sum("words").over(Window.partitionBy("part").orderBy("finish", "rank"))
            here = parts.where(F.col("part") == part).withColumn("upto", running + F.lit(before)).where(F.col("upto") >= budget)
            r = here.orderBy("finish", "rank").first()
            return r["finish"], r["rank"], budget - (r["upto"] - r["words"]), r["words"]
        before += words
    return None


def mix(scratch: Scratch, docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17, cut: str = "words", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, source, size, source_size, target and, for every round 0 .. most-1, finish_<round> and
    taken_<round>: one row per row of ``docs``."""
    queue = queued(scratch, docs, weights=weights, share=share, most=most, seed=seed, carry=carry)
    total = queue.agg(F.sum("size").alias("n")).first()["n"] or 0
    budget = int(min(share, most) * total)
    at = find_cut(scratch, schedule(queue, most, cut), budget) if total else None
    out = queue
    for turn in range(most):
        if at is None:
            taken = F.col("size")
        else:
            finish, rank, fit, words = at
            last = fit if cut == "words" else words if 2 * fit >= words else 0
            one = lambda p: F.when((p["finish"] < finish) | ((p["finish"] == finish) & (F.col("rank") < rank)), p["words"]).when((p["finish"] == finish) & (F.col("rank") == rank), F.lit(last).cast("long")).otherwise(F.lit(0).cast("long"))  # noqa: E731, B023
            taken = F.aggregate(packets(turn, cut), F.lit(0).cast("long"), lambda acc, p: acc + one(p))
        out = out.withColumn(f"finish_{turn}", F.try_divide((F.col(f"start_{turn}") + F.col("size")).cast("double"), F.col("target"))).withColumn(f"taken_{turn}", taken)
    return out.select("doc_id", *carry, "source", "size", "source_size", "target", *[f"{c}_{t}" for c in ("finish", "taken") for t in range(most)])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, 1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget, 2 * source_size AS cap FROM per),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM weighed),
placed AS (SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS place FROM levels),
lowest AS (SELECT *, (SELECT level FROM placed WHERE w * level <= cap ORDER BY place LIMIT 1) AS open_level FROM placed),
targets AS (SELECT source, source_size, rank, floor(budget)::BIGINT AS budget, CASE WHEN open_level IS NULL OR w * open_level > cap THEN cap::DOUBLE ELSE w * open_level END AS target FROM lowest),
turns AS (SELECT * FROM (VALUES (0), (1)) t(turn)),
queued AS (SELECT s.*, rank, budget, t.target, turn * t.source_size + coalesce(sum(size) OVER (PARTITION BY s.source, turn ORDER BY md5(concat_ws(':', '17', turn::VARCHAR, doc_id::VARCHAR)), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source CROSS JOIN turns),
stepped AS (SELECT *, CASE WHEN start < target AND start + size > target THEN (size + 1023) // 1024 ELSE size END AS step FROM queued WHERE size > 0),
packets AS (SELECT *, least(step, size - skip) AS words, (start + least(skip + step, size))::DOUBLE / target AS finish FROM (SELECT *, unnest(range(0, size, step)) AS skip FROM stepped)),
line AS (SELECT doc_id, words, budget, sum(words) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) - words AS before FROM packets),
taken AS (SELECT doc_id, sum(greatest(0, least(words, budget - before)))::BIGINT AS taken FROM line GROUP BY doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(taken, 0)::BIGINT AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken USING (doc_id)
"""
