"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token store.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet in
the shared folder and rereads them as the next stage's documents. Parameters here are the production ones.

Defined results, beyond those of the operators: rows are told apart by their place, so rows with a null or repeated
doc_id are each judged for themselves; of the rows that a group's kept id names, one stays;
rows without a word form no group, but the quality stage has removed them; rows with the same id that are taken twice
or more stand as often as each is taken; extra columns stay until the last stage; an empty table gives an empty result
at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.llm.common import Scratch, placed, read
from tilescape.llm.decontaminate import without_leaks
from tilescape.llm.mixing import mix
from tilescape.llm.near_dup import near_duplicates
from tilescape.llm.quality import keep_good
from tilescape.llm.token_store import read_store, write_store

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
COPIES = 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return keep_good(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id stays."""
    rows, place = placed(Scratch(spark, "dedup"), docs)
    kept = near_duplicates(spark, rows, width=5, percent=80, carry=place).where("kept")
    first = kept.where("group is not null").groupBy("group").agg(F.min(F.struct(*place)).alias("p"))
    stay = first.select("p.*").union(kept.where("group is null").select(*place))
    return rows.join(stay, list(place), "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return without_leaks(spark, docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, up to COPIES times each, so that every source comes near its target; one row per copy taken."""
    scratch = Scratch(spark, "mix")
    rows, place = placed(scratch, docs)
    copies = "_copies"
    while copies in rows.columns:
        copies = f"_{copies}"
    times = sum((F.col(f"taken_{t}") > 0).cast("int") for t in range(COPIES))
    taken = mix(scratch, rows, most=COPIES, cut="whole", carry=place).select(*place, F.array_repeat(F.lit(0), times).alias(copies)).where(F.size(copies) > 0)
    return rows.join(taken, list(place)).withColumn(copies, F.explode(copies)).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's documents, read back: doc_id, start, n_tokens, ids_crc32."""
    scratch = Scratch(spark, "tokens")
    path, tokenizer = scratch.path("out"), public_tokenizers.path(TOKENIZER)
    write_store(spark, docs, path, tokenizer=tokenizer, end_id=END_ID, scratch=scratch)
    return read_store(spark, path, tokenizer=tokenizer)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mixing", mixing), ("token_output", token_output)]

#: Quality distances, MinHash groups, edit distances and tokenisation are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
