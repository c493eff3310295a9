"""Folding, exceptions, and held-out accuracy."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilescape.llm import toxicity as X
from tilescape.llm.queries import op7_toxicity

LEX = X.Lexicon({"idiot": 4.0, "scum": 3.0, "trash": 2.0}, {"réeux": 3.0})


@pytest.mark.parametrize(
    ("text", "hits"),
    [("You IDIOT!", 1), ("1d10t", 1), ("іdіоt", 1), ("ｉｄｉｏｔ", 1), ("i\u200bdiot", 1), ("$cum", 1), ("idiot$$$ scum###", 2), ("idiotic", 0), ("xidiot", 0), ("trash can", 0), ("trash cans", 1), ("trash", 1), ("réeuxpa et", 1), ("préeuxpa", 0), ("", 0), (None, 0), ("idiot idiot", 2), ("50 1017", 0)],
)
def test_hits(text, hits):
    assert LEX.hits(text)[1] == hits


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_folding_keeps_offsets(text):
    low = X.visible(text)
    assert len(X.fold(low)) == len(low)
    assert 0 <= LEX.score(text) <= 1


def plain_hits(lexicon, text):
    """Every place of the text tried with every entry."""
    low = X.visible(text)
    folded = X.fold(low)
    starts_word = lambda at: at == 0 or not (low[at - 1].isalnum() or low[at - 1] in "$@")
    ends_word = lambda at: at == len(low) or not low[at].isalnum()
    spared = [(at, at + len(p)) for p in map(X.fold, lexicon.exceptions) for at in range(len(low)) if folded.startswith(p, at) and starts_word(at) and ends_word(at + len(p))]
    found = []
    for at in range(len(low)):
        if starts_word(at):
            weights = [w for term, w in lexicon.words.items() if folded.startswith(term, at) and ends_word(at + len(term))]
            weights += [w for term, w in lexicon.stems.items() if folded.startswith(term, at)]
            if weights and max(weights) > 0 and not any(a <= at < b for a, b in spared):
                found.append(max(weights))
    return sum(found), len(found), len(low.split())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["trash", "trash can", "idiot", "1d10t", "idiotic", "scum", "pond scum", "іdіоt", "$cum", "réeuxpa", "x", " ", " ", ", ", "\u200b", "!", "0"]), max_size=14).map("".join))
def test_matching_against_every_place_and_entry(text):
    assert LEX.hits(text) == pytest.approx(plain_hits(LEX, text))


def test_whole_table_against_plain_matching(spark, sample):
    df, rows = sample
    got = {r["doc_id"]: r for r in X.score(df, LEX).collect()}
    for r in rows:
        weight, hits, n = plain_hits(LEX, (r["text"] or "")) if len(r["text"] or "") < 3000 else LEX.hits(r["text"])
        assert got[r["doc_id"]]["hits"] == hits
        assert got[r["doc_id"]]["score"] == pytest.approx(X.logistic(LEX.coefficients, X.features(weight, n)))


def test_many_hits_and_phrases_take_linear_time():
    text = "trash can idiot " * 40_000
    assert LEX.hits(text)[1] == 40_000


def test_labels_that_disagree_count_as_toxic(spark, documents):
    bad = [(i, f"zorble text number {i}") for i in range(12)]
    good = [(100 + i, f"plain text number {i}") for i in range(12)]
    labels = [(i, 1) for i, _ in bad] + [(i, 0) for i, _ in bad] + [(i, 0) for i, _ in good]
    lexicon = X.train(spark, spark.createDataFrame(labels, "doc_id long, toxic int").repartition(7), documents(bad + good))
    assert lexicon.words.get("zorble", 0) > 2.5 and lexicon.score("a zorble") > lexicon.score("plain text")


def test_length_lowers_the_score():
    lex = X.Lexicon({"idiot": 4.0}, {})
    assert lex.score("idiot") > lex.score("idiot" + " word" * 300) > lex.score("word " * 300)


def test_held_out(spark):
    base = "/root/testdata/sf0.1"
    out = op7_toxicity(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out")
    r = out.agg(F.count_if(F.expr("toxic = 1 and predicted = 1")).alias("tp"), F.count_if(F.expr("toxic = 1")).alias("p"), F.count_if(F.expr("toxic = 0 and predicted = 1")).alias("fp"), F.count_if(F.expr("toxic = 0")).alias("n")).first()
    assert r["tp"] / r["p"] > 0.9 and r["fp"] / r["n"] < 0.02


def test_contract_and_edges(spark, documents):
    out = op7_toxicity(spark, "/root/testdata/sf0.001")
    assert [c for c, _ in out.dtypes][:4] == ["doc_id", "held_out", "score", "predicted"]
    assert out.where("(score >= 0.7) != (predicted = 1) or score < 0 or score > 1 or score is null").isEmpty() and out.count() == 200
    df = documents([(1, None), (2, ""), (3, "an idiot"), (3, "an idiot"), (4, "word " * 100_000)], score="clash", hits="clash")
    got = X.score(df, LEX).collect()
    assert len(got) == 5 and {r["hits"] for r in got if r["doc_id"] == 3} == {1}
    assert X.score(documents([]), LEX).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.train(spark, nothing, df).words["idiot"] == X.SEED_WEIGHT
