"""Content-addressed store of token ids.

Documents are encoded, a rolling hash over the ids cuts each id stream into chunks, and every different chunk
is stored once, with the first document (in doc_id order) that has it. All other places hold the chunk's digest
only. The store is a Parquet folder in ascending doc_id order, one row per document:

    part, doc_id, uid, n_tokens, local_start   place: tokens before the document = tokens of earlier parts + local_start
    digests, lens                              recipe: 16-byte BLAKE2b of every chunk, and its number of ids
    held, shared                               positions of chunks whose ids stand here; those that others refer to
    data                                       the ids of the held chunks, little-endian, 2 or 4 bytes each
    leaf                                       BLAKE2b of the digests

and a manifest, one row per part: part, n_docs, n_tokens, merkle root of the leaves. Reading back fetches the
chunks held elsewhere by digest, rebuilds every document, and recomputes digests, leaves and roots; any
difference raises. Only chunks with copies elsewhere move between tasks.

Encoding splits texts at spaces between two characters other than white space. The byte-level pre-tokenizer
always ends a piece there, so that the ids of a text are those of its segments in a row, and repeated segments
are encoded by the library once.

Defined results: a null text is encoded as an empty one (the end id alone); repeated doc_ids stand next to each
other, told apart by uid; a null doc_id comes first; extra columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.llm.common import Scratch, bound_batches

WINDOW = 8
#: A chunk ends where this many low bits of the rolling hash are zero: 256 ids on average, within the limits below.
MASK_BITS = 8
SHORTEST, LONGEST = 64, 1024
#: Pieces that a Python worker remembers before it drops those that the last texts did not have.
REMEMBERED = 1_000_000
#: Texts that are encoded together.
GROUP_BYTES = 4 << 20
#: White space other than the space and the line feed.
_OTHER_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")

#: Bytes of ids of a part of the store, whose leaves one task hashes into a root.
PART_BYTES = 128 << 20

STORE = "part int, doc_id long, uid long, n_tokens long, local_start long, digests array<binary>, lens array<int>, held array<int>, shared array<int>, data binary, leaf binary"


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin .. begin + size of all ranges in a row."""
    upto = np.cumsum(size, dtype=np.int64)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, int(begin.max(initial=0))) < 1 << 30 else np.int64
    at = np.repeat((begin - (upto - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return at


class _Learned:
    """Ids of the pieces met so far: pieces in an Arrow array, their ids in a row in another."""

    def __init__(self, dtype: np.dtype) -> None:
        self.pieces, self.ids, self.size = pa.array([], pa.string()), np.empty(0, dtype), np.empty(0, np.int64)

    def begin(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    def add(self, pieces: pa.Array, ids: list[list[int]]) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), self.ids.dtype)])
        self.size = np.concatenate([self.size, np.fromiter(map(len, ids), np.int64, len(ids))])

    def keep(self, at: np.ndarray) -> None:
        """Drop all but the pieces at these places."""
        self.ids = self.ids[spread(self.begin()[at], self.size[at])]
        self.pieces, self.size = self.pieces.take(pa.array(at)), self.size[at]


class Encoder:
    """Ids of texts by the tokenizers library.

    Byte-level vocabularies are encoded by segment: texts are cut at spaces, and the different segments into pieces (letters,
    digits, signs or a line feed, with or without a space before) where the pre-tokenizer cuts them too. Each different
    piece goes straight to the merges of the vocabulary, once; what is made of other characters goes through the library.
    """

    LETTERS = "A-Za-zÀ-ÖØ-öø-ſΑ-ΡΣ-Ωα-ωА-я"
    #: ASCII signs but the apostrophe, which begins contractions.
    SIGNS = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
    PIECE = f"( ?[{LETTERS}]+| ?[0-9]+| ?[{SIGNS}]+|\n)"
    #: Segments that PIECE cuts as the pre-tokenizer does: no white space but single line feeds, and none after the space.
    REGULAR = f"^(?: ?[{LETTERS}0-9{SIGNS}]+)?(?:\n[{LETTERS}0-9{SIGNS}]+)*\n?$"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        made = json.loads(self.tokenizer.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.by_segment = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.learned = _Learned(self.dtype)
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # the byte-level alphabet of the characters that pieces are made of
        self.table = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x20, 0x450) if re.fullmatch(f"[ {self.LETTERS}0-9{self.SIGNS}]", chr(c))} | {10: level.pre_tokenize_str("\n")[0][0]}
        # a space with white space at its side is no place to cut; special tokens are for the library alone
        self.unsafe = "|".join(["  ", "\n ", " \n", f"[{_OTHER_WHITE}]", *("".join(c if c.isalnum() else f"\\{c}" for c in s) for s in self.special)])
        # trust the short way only if it gives what the library gives
        probe = " naïve,\nword one 12."
        self.direct = self.by_segment and [i for x in (" naïve", ",", "\n", "word", " one", " 12", ".") for i in self._merged(pa.array([x]))[0]] == self.whole(probe)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _merged(self, pieces: pa.Array) -> list[list[int]]:
        tokenize, table = self.tokenizer.model.tokenize, self.table
        plain = pc.replace_substring(pc.replace_substring(pieces, " ", table[32]), "\n", table[10])  # ASCII signs and letters stand for themselves
        names = pc.if_else(pc.string_is_ascii(pieces), plain, pieces).to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        other = np.flatnonzero(~pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False)).tolist()
        for i in other:
            names[i] = names[i].translate(table)
        return [[t.id for t in tokenize(p)] for p in names]

    def __call__(self, text: str) -> bytes:
        """Packed ids of one text."""
        return self.batch(pa.array([text], pa.string()), 0)[0][:-1].tobytes()

    def _cut(self, segments: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of segments: numbers of the pieces in a row, how many each segment has; ids of the pieces, where they
        begin, how many each has. Segments marked as whole go through the library as they are."""
        mask = lambda pattern: pc.match_substring_regex(segments, pattern).to_numpy(zero_copy_only=False) if self.direct else whole
        words, regular = mask(f"^ ?[{self.LETTERS}]+$") & ~whole, mask(self.REGULAR) & ~whole  # a word is one piece, and most segments are words
        mixed = regular & ~words
        odd = np.flatnonzero(~regular)
        cut = pc.split_pattern(pc.replace_substring_regex(segments.filter(pa.array(mixed)), self.PIECE, "\x1f\\1"), "\x1f")
        ends = cut.offsets.to_numpy().astype(np.int64)
        wanted = np.ones(ends[-1] - ends[0], bool)
        wanted[ends[:-1] - ends[0]] = False  # what stands before the first piece, nothing
        coded = pa.concat_arrays([segments.filter(pa.array(words)), cut.flatten().filter(pa.array(wanted))]).dictionary_encode()
        pieces = coded.dictionary
        at = pc.index_in(pieces, value_set=self.learned.pieces)
        if at.null_count:
            new = pieces.filter(at.is_null())
            self.learned.add(new, self._merged(new))
            at = at.fill_null(-1).to_numpy().copy()
            at[at < 0] = np.arange(len(self.learned.pieces) - len(new), len(self.learned.pieces))
        else:
            at = at.to_numpy()
        if len(self.learned.pieces) > REMEMBERED:
            self.learned.keep(at)
            at = np.arange(len(pieces))
        # each odd segment is one piece of its own, after all others
        others = [self.whole(s) for s in segments.take(pa.array(odd)).to_pylist()]
        size = np.concatenate([self.learned.size, np.fromiter(map(len, others), np.int64, len(others))])
        ids = np.concatenate([self.learned.ids, np.fromiter(chain.from_iterable(others), self.dtype)])
        count = np.ones(len(segments), np.int64)
        count[mixed] = np.diff(ends) - 1
        numbers = np.empty(int(count.sum()), np.int64)
        known, single = at[coded.indices.to_numpy()], int(words.sum())
        kind = np.repeat(np.where(words, 0, np.where(mixed, 1, 2)), count)
        numbers[kind == 0], numbers[kind == 1] = known[:single], known[single:]
        numbers[kind == 2] = len(self.learned.size) + np.arange(len(odd))
        return numbers, count, ids, np.cumsum(size) - size, size

    def batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each closed by the end id, and the places where they end.

        The segments of all texts are numbered by Arrow, so that each different one is cut once.
        """
        unsafe = pc.match_substring_regex(texts, self.unsafe) if self.by_segment else pa.array(np.ones(len(texts), bool))
        split = pc.split_pattern(pc.if_else(unsafe, "", texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        spaced = pc.binary_join_element_wise(pa.scalar(" "), coded.dictionary, pa.scalar(""))
        first = split.values.take(pa.array(offsets[:-1]))  # no space precedes a text's first segment
        rest, uncut, places = [], [], []
        for i in np.flatnonzero(unsafe.to_numpy(zero_copy_only=False)).tolist():
            parts = self._parts(text := texts[i].as_py())
            rest += parts
            uncut += [any(s in text for s in self.special)] * len(parts)
            places.append((i, len(parts)))
        numbers, count, ids, begin, size = self._cut(pa.concat_arrays([spaced, first, pa.array(rest, pa.string())]), np.concatenate([np.zeros(len(spaced) + len(texts), bool), np.array(uncut, bool)]))
        # the segments' numbers text by text; a safe text's are its split, another's its parts
        number = coded.indices.to_numpy().astype(np.int64)
        number[offsets[:-1]] = len(spaced) + np.arange(len(texts))
        each = np.diff(offsets)
        if places:
            where = np.array([i for i, _ in places])
            parts = np.array([n for _, n in places])
            keep = np.ones(len(number), bool)
            keep[offsets[where]] = False  # the empty stand-in
            number = np.insert(number[keep], np.repeat(offsets[where] - np.arange(len(where)), parts), len(spaced) + len(texts) + np.arange(parts.sum()))
            each[where] = parts
        # the end id is one more segment, of one more piece
        number = np.insert(number, np.cumsum(each), len(count))
        numbers, count = np.append(numbers, len(size)), np.append(count, 1)
        begin, size, ids = np.append(begin, len(ids)), np.append(size, 1), np.append(ids, np.array([end_id], self.dtype))
        first_piece = np.cumsum(count) - count
        per_segment = np.add.reduceat(size[numbers], first_piece[count > 0]) if len(numbers) else np.empty(0, np.int64)
        length = np.zeros(len(count), np.int64)
        length[count > 0] = per_segment
        pieces = numbers[spread(first_piece[number], count[number])]
        out = ids[spread(begin[pieces], size[pieces])]
        stops = np.cumsum(length[number])[np.cumsum(each + 1) - 1]
        return out, stops

    def _parts(self, text: str) -> list[str]:
        """A text in parts that can be encoded one by one: at spaces between two characters other than white space."""
        if not self.by_segment or any(s in text for s in self.special):
            return [text]
        out = before = None
        for p in text.split(" "):
            if out is None:
                out = [p]
            elif p and before and not p[0].isspace() and not before[-1].isspace():
                out.append(f" {p}")
            else:
                out[-1] += f" {p}"
            before = p
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=1)
def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 1 << 16, dtype=np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids ends in zeros. A chunk is never shorter than the
    window, so documents in a row may be hashed together."""
    out = []
    for start in range(0, len(ids), 1 << 19):  # in parts, for memory's sake; a part begins a window early
        early = min(start, WINDOW - 1)
        gear = _gear()[ids[start - early : start + (1 << 19)] & 0xFFFF]
        acc = gear.copy()
        for j in range(1, min(WINDOW, len(gear))):
            acc[j:] += gear[:-j] << np.uint32(j)
        out.append(np.flatnonzero(acc[early:] >> np.uint32(32 - MASK_BITS) == 0) + start + 1)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    return cut_between(marks(ids).tolist(), 0, len(ids))


def cut_between(at: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of ids start .. stop, from the marks of the whole stream."""
    ends, last = [], start
    k = bisect_left(at, start)
    while stop - last > SHORTEST:
        k = bisect_left(at, last + SHORTEST, k)
        end = min(at[k] if k < len(at) else stop, last + LONGEST, stop)
        ends.append(end)
        last = end
    if last < stop or not ends:
        ends.append(stop)
    return ends


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over the leaves; an odd one at the end of a level moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def by_bytes(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of text, or of one row."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _encode(path: str, end_id: int) -> Callable:
    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())), ("lens", pa.list_(pa.int32())), ("data", pa.binary()), ("leaf", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        size, uid = enc.dtype.itemsize, TaskContext.get().partitionId() << 36

        def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal uid
            texts = pa.concat_arrays([b.column("text") for b in held]).fill_null("")
            ids, stops = enc.batch(texts, end_id)
            if len(ids) * size >= 1 << 31:
                raise ValueError("a text has more ids than one Arrow value can hold")
            stream, found = memoryview(ids.tobytes()), marks(ids).tolist()
            digests, lens, counts, leaves, at = [], [], [0], [], 0
            for stop in stops.tolist():
                for end in cut_between(found, at, stop):
                    digests.append(digest(stream[at * size : end * size]))
                    lens.append(end - at)
                    at = end
                leaves.append(digest(b"".join(digests[counts[-1] :])))
                counts.append(len(lens))
            offsets = pa.array(counts, pa.int32())
            uids = pa.array(range(uid, uid + len(texts)), pa.int64())
            uid += len(texts)
            places = pa.py_buffer(np.concatenate([[0], stops * size]).astype(np.int32).tobytes())
            data = pa.Array.from_buffers(pa.binary(), len(texts), [None, places, pa.py_buffer(stream)])
            doc = pa.concat_arrays([b.column("doc_id") for b in held])
            tokens = pa.array(np.diff(stops, prepend=0), pa.int64())
            return pa.RecordBatch.from_arrays([doc, uids, tokens, pa.ListArray.from_arrays(offsets, pa.array(digests, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(lens, pa.int32())), data, pa.array(leaves, pa.binary())], schema=schema)

        held, weight = [], 0
        for batch in it:
            for part in by_bytes(batch, GROUP_BYTES):
                held.append(part)
                weight += part.nbytes
                if weight >= GROUP_BYTES:
                    yield pack(held)
                    held, weight = [], 0
        if held:
            yield pack(held)

    return run


def _lay_out(width: int) -> Callable:
    """Rows sorted by (doc_id, uid, kind): a note on a document's chunks, if any, then the document.

    Documents without a note, most of them, pass as Arrow columns.
    """
    names = [c.split()[0] for c in STORE.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, note = TaskContext.get().partitionId(), 0, None
        for batch in it:
            kind = batch.column("kind").to_numpy()
            docs = batch.filter(pa.array(kind == 1))
            n = docs.num_rows
            lens = docs.column("lens")
            offsets = lens.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
            count = np.diff(offsets)
            position = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count)
            keep = np.ones(len(position), bool)
            shared: list[list[int]] = [[]] * n
            data = docs.column("data")
            changed: dict[int, bytes] = {}
            noted = {} if note is None else {note["uid"]: note}  # the document of the last batch's last note may come first here
            for r in batch.filter(pa.array(kind == 0)).select(["uid", "gone", "shared"]).to_pylist():
                noted[r["uid"]] = note = r
            if noted:
                uids = docs.column("uid").to_numpy()
                for i in np.flatnonzero(np.isin(uids, np.fromiter(noted, np.int64, len(noted)))).tolist():
                    r = noted[int(uids[i])]
                    shared[i] = sorted(r["shared"])
                    if r["gone"]:
                        keep[offsets[i] + np.array(r["gone"])] = False
                        each = lens[i].as_py()
                        ends = np.cumsum(each) * width
                        raw, gone = data[i].as_py(), set(r["gone"])
                        changed[i] = b"".join(raw[ends[k] - each[k] * width : ends[k]] for k in range(len(each)) if k not in gone)
            kept = np.concatenate([[0], np.cumsum(np.add.reduceat(keep.astype(np.int64), offsets[:-1]) if n else [])]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(kept), pa.array(position[keep].astype(np.int32)))
            if changed:
                data = pa.array([changed.get(i, v) for i, v in enumerate(data.to_numpy(zero_copy_only=False).tolist())], pa.binary())
            tokens = docs.column("n_tokens").to_numpy()
            start = total + np.cumsum(tokens) - tokens
            total += int(tokens.sum())
            columns = [pa.array(np.full(n, part, np.int32)), docs.column("doc_id"), docs.column("uid"), docs.column("n_tokens"), pa.array(start, pa.int64()), docs.column("digests"), lens, held, pa.array(shared, pa.list_(pa.int32())), data, docs.column("leaf")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _roots(rows):
    import pandas as pd

    rows = rows.sort_values("local_start", kind="stable")
    return pd.DataFrame({"part": rows["part"].iloc[:1], "n_docs": [len(rows)], "n_tokens": [int(rows["n_tokens"].sum())], "root": [merkle(list(rows["leaf"]))]})


MANIFEST = "part int, n_docs long, n_tokens long, root binary"


def write_store(spark: SparkSession, docs: DataFrame, path: str, *, tokenizer: str, end_id: int, scratch: Scratch) -> None:
    """Encode ``docs`` (doc_id, text) and write the store and its manifest beneath ``path``."""
    bound_batches(spark)
    width = encoder(tokenizer).dtype.itemsize
    staged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = scratch.table(staged.mapInArrow(_encode(tokenizer, end_id), "doc_id long, uid long, n_tokens long, digests array<binary>, lens array<int>, data binary, leaf binary"), "encoded")
    places = staged.select("doc_id", "uid", F.posexplode("digests").alias("pos", "digest"))
    owner = F.min(F.struct("doc_id", "uid", "pos")).alias("owner")
    copied = places.groupBy("digest").agg(owner, F.count("*").alias("n")).where("n > 1").drop("n")
    notes = places.join(copied, "digest").withColumn("mine", (F.col("owner.uid") == F.col("uid")) & (F.col("owner.pos") == F.col("pos")))
    notes = notes.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.when(~F.col("mine"), F.col("pos"))).alias("gone"), F.collect_list(F.when(F.col("mine"), F.col("pos"))).alias("shared"))
    notes = notes.select("doc_id", "uid", F.lit(0).alias("kind"), "gone", "shared", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("array<binary>").alias("digests"), F.lit(None).cast("array<int>").alias("lens"), F.lit(None).cast("binary").alias("data"), F.lit(None).cast("binary").alias("leaf"))
    notes = scratch.table(notes, "notes")
    none = F.lit(None).cast("array<int>")
    rows = notes.union(staged.select("doc_id", "uid", F.lit(1), none, none, "n_tokens", "digests", "lens", "data", "leaf"))
    held = (staged.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0) * width
    parts = -(-held // PART_BYTES)
    # large stores get as many parts as their bytes ask for; smaller ones the session's number, which Spark may lower
    many = (parts,) if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else ()
    ordered = rows.repartitionByRange(*many, "doc_id", "uid").sortWithinPartitions("doc_id", "uid", "kind")
    ordered.mapInArrow(_lay_out(width), STORE).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/store")
    store = spark.read.schema(STORE).parquet(f"{path}/store")
    roots = store.select("part", "local_start", "n_tokens", "leaf").groupBy("part").applyInPandas(_roots, MANIFEST)
    roots.write.mode("overwrite").parquet(f"{path}/manifest")
    scratch.drop("encoded", "notes")


def _supply(width: int) -> Callable:
    schema = pa.schema([("digest", pa.binary()), ("chunk", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: tuple[list, list] = ([], [])
            for r in batch.to_pylist():
                at, wanted = 0, set(r["shared"])
                for k in r["held"]:
                    n = r["lens"][k] * width
                    if k in wanted:
                        out[0].append(r["digests"][k])
                        out[1].append(r["data"][at : at + n])
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in out], schema=schema)

    return run


BUILT = "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long, ids binary"


def _rebuild(dtype: str, with_ids: bool, partial: bool) -> Callable:
    """Documents from their own chunks, and for partial ones from fetched chunks too. Every chunk is hashed again."""
    width = np.dtype(dtype).itemsize

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, crc, out = [], [], []
            read = lambda c: batch.column(c).to_numpy(zero_copy_only=False).tolist() if c in ("data", "leaf") else batch.column(c).to_pylist()  # noqa: B023, E731
            sizes, bounds = batch.column("lens").flatten().to_numpy().tolist(), batch.column("lens").offsets.to_numpy().tolist()
            sizes = [sizes[a - bounds[0] : b - bounds[0]] for a, b in zip(bounds, bounds[1:], strict=False)]
            more = zip(read("held"), read("fetched"), strict=True) if partial else (((), None) for _ in range(batch.num_rows))
            for lens, data, leaf, (held, fetched) in zip(sizes, read("data"), read("leaf"), more, strict=True):
                if partial:
                    got, at = {c["pos"]: c["chunk"] for c in fetched or ()}, 0
                    for k in held:
                        got[k] = data[at : at + lens[k] * width]
                        at += lens[k] * width
                    data = b"".join([got.get(k, b"") for k in range(len(lens))])
                at, seen, view = 0, [], memoryview(data)
                for size in lens:
                    seen.append(digest(view[at : at + size * width]))
                    at += size * width
                if at != len(data) or digest(b"".join(seen)) != leaf:
                    raise ValueError("the store does not give back a document")
                ids = np.frombuffer(data, dtype)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4")))
                out.append(data if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(out, pa.binary())], names=[c.split()[0] for c in BUILT.split(", ")])

    return run


def read_store(spark: SparkSession, path: str, *, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, packed, if wanted) of every document, rebuilt from the files."""
    bound_batches(spark)
    dtype = encoder(tokenizer).dtype
    store = spark.read.schema(STORE).parquet(f"{path}/store")
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    seen = store.select("part", "local_start", "n_tokens", "leaf").groupBy("part").applyInPandas(_roots, MANIFEST)
    parts = sorted(tuple(r) for r in manifest.collect())  # one row per part: a few thousand numbers at any size of the corpus
    if sorted(tuple(r) for r in seen.collect()) != parts:
        raise ValueError("the store does not match its manifest")
    full = F.size("held") == F.size("lens")
    supply = store.where(F.size("shared") > 0).select("digests", "lens", "held", "shared", "data").mapInArrow(_supply(dtype.itemsize), "digest binary, chunk binary")
    wanted = store.where(~full).select("uid", "held", F.posexplode("digests").alias("pos", "digest")).where(~F.array_contains("held", F.col("pos"))).drop("held")
    fetched = wanted.join(supply, "digest").groupBy("uid").agg(F.collect_list(F.struct("pos", "chunk")).alias("fetched"))
    place = ["doc_id", "part", "local_start", "lens", "data", "leaf"]
    whole = store.where(full).select(*place).mapInArrow(_rebuild(dtype.str, with_ids, False), BUILT)
    partial = store.where(~full).select(*place, "held", "uid").join(fetched, "uid", "left").select(*place, "held", "fetched").mapInArrow(_rebuild(dtype.str, with_ids, True), BUILT)
    built = whole.union(partial)
    before, offsets = 0, []
    for part, _, tokens, _ in parts:
        offsets.append((part, before))
        before += tokens
    starts = F.broadcast(spark.createDataFrame(offsets or [(-1, 0)], "part int, before long"))
    out = built.join(starts, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
    return out
