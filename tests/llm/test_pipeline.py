"""Each stage on its own input against brute force, and the run end to end."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm import test_decontaminate, test_mixing, test_near_dup, test_quality
from tilescape.llm import decontaminate
from tilescape.llm.common import Scratch

DATA = "/root/testdata/sf0.001"


def test_stages(spark, sample):
    df, _ = sample
    scratch = Scratch(spark, "stages")
    docs, inputs = df, []
    for name, stage in P.STAGES:
        out = scratch.table(stage(spark, docs, DATA), name)
        inputs.append((docs.collect(), out.collect()))
        if name != P.STAGES[-1][0]:
            assert out.columns == df.columns
        docs = out
    (before, after) = inputs[0]
    assert after and not any(test_quality.brute(r["text"])[5] for r in after)
    (before, after) = inputs[1]
    kept = {i for i, v in test_near_dup.brute([(r["doc_id"], r["text"]) for r in before], 5, 80).items() if v[2]}
    assert {r["doc_id"] for r in after} == kept and len(after) == len(kept)
    (before, after) = inputs[2]
    items = [decontaminate.normalised(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    short = lambda r: len(r["text"]) < 1500  # noqa: E731  the plain table takes long on long texts
    clean = {r["doc_id"] for r in before if not short(r) or not any(test_decontaminate.best_distance(t, decontaminate.normalised(r["text"])) <= len(t) // 10 for t in items[:12])}
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} & clean
    assert not any(t in decontaminate.normalised(r["text"]) for r in after for t in items)
    (before, after) = inputs[3]
    plain = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in before]
    taken, target, _ = test_mixing.brute(plain, "whole")
    assert Counter(r["doc_id"] for r in after) == +Counter({r[0]: sum(taken[i, t] > 0 for t in range(P.COPIES)) for i, r in enumerate(plain)})
    for source, wanted in target.items():
        size = lambda rows: [len(r["text"].split()) for r in rows if r["source"] == source]  # noqa: B023, E731
        assert abs(sum(size(after)) - wanted) <= max(size(before))
    (before, after) = inputs[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, expected = 0, []
    for r in sorted(before, key=lambda r: r["doc_id"]):
        ids = library.encode(r["text"], add_special_tokens=False).ids + [2]
        expected.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, after)) == sorted(expected)


def test_run(spark):
    out = P.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100


def test_stages_with_null_and_repeated_ids_and_clashing_names(spark, documents):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, prose(1)), (1, prose(1)), (1, prose(2)), (None, prose(3)), (None, prose(4)), (5, prose(1) + " tail"), (6, None), (7, ""), (8, prose(5), None, None)]
    df = documents(rows, _file="clash", _row=1, size=2, component_id=3, taken_0=4, _copies=5, _metadata=6)
    deduped = P.near_dedup(spark, df, DATA)
    assert deduped.columns == df.columns
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in deduped.collect()) == sorted((repr(i), t or "") for i, t, *_ in [rows[0], *rows[2:5], *rows[6:]])  # two documents share the id 1
    clean = P.decontaminate(spark, deduped, DATA)
    assert clean.columns == df.columns and clean.count() == deduped.count()
    mixed = P.mixing(spark, df.where("length(text) > 0"), DATA)
    assert mixed.columns == df.columns
    taken = Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert set(taken) <= {(r[0], r[1]) for r in rows} and taken[1, prose(1)] in (2, 3, 4)
    assert sum(n * len(t.split()) for (_, t), n in taken.items()) >= 1.5 * 420 - 61
    assert P.token_output(spark, df, DATA).count() == len(rows)


def test_stages_of_empty_tables(spark, documents):
    for _, stage in P.STAGES:
        assert stage(spark, documents([]), DATA).count() == 0
