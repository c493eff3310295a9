"""The queries of this subpackage: thin functions that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.llm import decontaminate, html_text, language_id, mixing, near_dup, pii, quality, token_store, toxicity, url_filter
from tilescape.llm.common import Scratch, read


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.train(spark, url_filter.labelled_urls(spark))
    return url_filter.judge(read(spark, sf_dir, "pages"), model)


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(spark, read(spark, sf_dir, "documents"), width=3, percent=85).drop("group")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(spark, read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(Scratch(spark, "mix"), read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("taken_0") + F.col("taken_1")).alias("taken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where((language_id.remainder("doc_id", 3) != 1) & F.col("toxic").isNotNull())
    lexicon = toxicity.train(spark, labels, docs.select("doc_id", "text"))
    return toxicity.score(docs, lexicon).select("doc_id", (language_id.remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "hits")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, read(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(spark, docs.where(language_id.remainder("doc_id", 4) != 2))
    return language_id.identify(docs, model).select("doc_id", (language_id.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    path, tokenizer = scratch.path("out"), public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_store(spark, read(spark, sf_dir, "documents"), path, tokenizer=tokenizer, end_id=2, scratch=scratch)
    return token_store.read_store(spark, path, tokenizer=tokenizer)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filter, op2_minhash_near_dup, op3_decontamination, op4_quality_rules, op5_pii, op6_mixing, op7_toxicity, op8_html_text, op9_language_id, op10_token_store)}

ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.ORACLE}
