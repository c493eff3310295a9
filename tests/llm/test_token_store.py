"""Exact round trips through the files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilescape.llm import token_store as T
from tilescape.llm.common import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def store(spark, df):
    scratch = Scratch(spark, "tokens")
    path = scratch.path("out")
    T.write_store(spark, df, path, tokenizer=PATH, end_id=2, scratch=scratch)
    return path


def expected(library, rows):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table(spark, sample, library):
    df, rows = sample
    path = store(spark, df)
    got = [tuple(r) for r in T.read_store(spark, path, tokenizer=PATH).orderBy("start").collect()]
    assert got == expected(library, [(r["doc_id"], r["text"]) for r in rows])
    files = spark.read.parquet(f"{path}/store")
    assert files.agg(F.countDistinct("part")).first()[0] == spark.read.parquet(f"{path}/manifest").count()
    held = files.select(F.explode(F.transform("held", lambda k: F.get("digests", k))).alias("digest"))
    assert held.count() == held.distinct().count() == files.select(F.explode("digests")).distinct().count()


@pytest.mark.parametrize("rows_per_batch", [1, 2, 512])
def test_copies_are_stored_once_and_ids_come_back(spark, documents, library, rows_per_batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_per_batch))
    text = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, text + f" tail {i}") for i in range(20)] + [(99, None), (100, ""), (50, text + " tail 3"), (50, text + " tail 3"), (None, "no id")]
    path = store(spark, documents(rows, part="clash", uid="clash"))
    out = T.read_store(spark, path, tokenizer=PATH, with_ids=True).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out] == expected(library, rows)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == r["n_tokens"] and ids[-1] == 2
    stored = spark.read.parquet(f"{path}/store").agg(F.sum(F.length("data"))).first()[0]
    assert stored < 4 * 2 * out[1]["n_tokens"]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_stores_get_parts_by_their_bytes(spark, documents, library, monkeypatch):
    monkeypatch.setattr(T, "PART_BYTES", 200)
    rows = [(i, f"document number {i} of a few words " * (1 + i % 5)) for i in range(200)]
    path = store(spark, documents(rows))
    assert spark.read.parquet(f"{path}/manifest").count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = [tuple(r) for r in T.read_store(spark, path, tokenizer=PATH).orderBy("start").collect()]
    assert got == expected(library, rows)


def test_damage_is_found(spark, documents):
    path = store(spark, documents([(1, "a b c"), (2, "d e f")]))
    stored = [r.asDict() for r in spark.read.parquet(f"{path}/store").collect()]
    broken = spark.createDataFrame([r | {"data": bytes(reversed(r["data"]))} for r in stored], T.STORE)
    broken.write.mode("overwrite").parquet(f"{path}/store")
    with pytest.raises(Exception, match="does not give back"):
        T.read_store(spark, path, tokenizer=PATH).collect()
    broken.limit(1).write.mode("overwrite").parquet(f"{path}/store")
    with pytest.raises(ValueError, match="manifest"):
        T.read_store(spark, path, tokenizer=PATH)


def test_empty_table(spark, documents):
    assert T.read_store(spark, store(spark, documents([])), tokenizer=PATH).count() == 0


def test_segments_give_the_librarys_ids(library):
    rng = random.Random(4)
    bits = ["a", " ", "  ", "\n", "\n\n", "'s", "é", "1", "23", ".", "!", "<|endoftext|>", "word", "The", "\t", " ", "漢字", "don't", "x'", "🙂", "\r\n", " ", "Ünï", ".\nSo", "é", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    ids, stops = T.encoder(PATH).batch(pa.array(texts), 2)
    assert ids[stops - 1].tolist() == [2] * len(texts)
    for text, part in zip(texts, np.split(ids, stops[:-1]), strict=True):
        assert part[:-1].tolist() == library.encode(text, add_special_tokens=False).ids
    assert T.encoder(PATH)(texts[0]) == ids[: stops[0] - 1].tobytes()


def test_characters_give_the_librarys_ids(library):
    """Every character of the first planes' beginnings, beside letters, digits and signs."""
    texts = [f"a{c} {c}b {c}{c}.{c} 1{c}\n{c}" for c in map(chr, [*range(1, 0x530), 0x660, 0x2019, 0x3000, 0x4E00, 0x1F600])]
    ids, stops = T.encoder(PATH).batch(pa.array(texts), 2)
    for text, part in zip(texts, np.split(ids, stops[:-1]), strict=True):
        assert part[:-1].tolist() == library.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    encode = T.Encoder(PATH)
    for texts in (["one two three four", ""], ["five two, two.", "one"], ["one two three four five"]):
        ids, stops = encode.batch(pa.array(texts), 2)
        assert [p[:-1].tolist() for p in np.split(ids, stops[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "", "c" * 9, "dd", "ee"])], names=["text"])
    parts = [p.column("text").to_pylist() for p in T.by_bytes(batch, 4)]
    assert parts == [["ab", None, ""], ["c" * 9], ["dd", "ee"]]


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50_000, 20_000).astype(np.uint16)
    b = np.concatenate([rng.integers(0, 50_000, 37).astype(np.uint16), a])
    chunks = lambda x: {x[s:e].tobytes() for s, e in zip([0, *T.cuts(x)[:-1]], T.cuts(x), strict=True)}
    assert len(chunks(a) & chunks(b)) > 0.9 * len(chunks(a))
    sizes = np.diff([0, *T.cuts(a)])
    assert sizes.sum() == len(a) and sizes.max() <= T.LONGEST and sizes[:-1].min() >= T.SHORTEST
    assert T.cuts(a[:1]) == [1]


def test_merkle_root_changes_with_order():
    leaves = [T.digest(bytes([i])) for i in range(5)]
    assert T.merkle(leaves) != T.merkle(leaves[::-1]) and T.merkle(leaves[:1]) == leaves[0]
