"""Base spans against the patterns themselves; the label model on planted votes."""

import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilescape.llm import pii
from tilescape.llm.queries import op5_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def brute(t):
    t = t or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ1240@.+- (%é\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_whole_table(spark, sample):
    _, rows = sample
    got = {r["doc_id"]: r for r in op5_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(rows)
    for r in rows:
        base, g = brute(r["text"]), got[r["doc_id"]]
        assert [g[f"n_{k}"] for k in pii.BASE] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert g["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(filter(None, pii.joined(base).split(","))) <= set(g["spans"].split(","))


def test_planted_spans(spark, documents):
    secret = "9c8b45435718dcc700c184a79c8b45435718dcc7"
    rows = [(i, f"some words here token = \"{secret[i:]}{secret[:i]}\" and more") for i in range(12)] + [(50, "mail me.x@a.b.org or +1 (115) 555-9688 now"), (51, None), (52, ""), (53, "plain prose, 12 apples"), (54, "Mr James Smith called")]
    rows += [(60 + i, f"commit sha {secret[:8]}-not-a-{'z' * 20} order") for i in range(12)]
    got = {r["doc_id"]: r for r in pii.detect(spark, documents(rows, spans="clash", base="clash")).collect()}
    assert all("secret:" in got[i]["spans"] for i in range(12)) and not any(got[60 + i]["spans"] for i in range(12))
    assert got[50]["spans"] == "email:5:17,phone:21:38" and [got[i]["spans"] for i in (51, 52, 53)] == [""] * 3
    assert pii.redacted("mail me.x@a.b.org or", "email:5:17") == "mail <email> or"
    assert pii.detect(spark, documents([])).count() == 0


def test_very_long_runs():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 100_000, "1." * 50_000, "A1" * 100_000):
        pii.base_spans(text)
        pii.candidates(text, [])
    assert pii.base_spans("0" * 5000 + "1.2.3.4") == [(1, 0, 5007)]


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    right = np.array([0.95, 0.9, 0.7, 0.85, 0.6])
    v = np.where(rng.random((len(truth), 5)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    patterns, inverse, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    posterior, p, share = pii.expectation_maximisation(patterns, counts.astype(float))
    assert abs(share - 0.4) < 0.03
    assert np.allclose(p[:, 1, 2], right, atol=0.04) and np.allclose(p[:, 0, 0], right, atol=0.04)
    assert ((posterior[inverse] > 0.5) == truth).mean() > 0.97


def plain_candidates(text, taken):
    """Every match of every pattern; the leftmost and of those the longest first, never over one before or a taken one."""
    found = [(m.start(), -m.end(), pii.KINDS.index(kind)) for kind, p in pii._CANDIDATES for m in p.finditer(text) if kind != "secret" or (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]))]
    out = []
    for start, end, kind in sorted(found):
        if not any(s < -end and start < e for _, s, e in taken + out):
            out.append((kind, start, -end))
    return out


PARTS = ["James Smith", "Mary J. Jones", " ", ", ", "123-45-6789", "a1b2c3d4e5f6a1b2c3d4e5f6", "+1 (115) 555-9688", "x@y.org", "020 7946 0958", "1.2.3.4", "DE89 3704 0044 0532 0130 00", "4539578763621486", "token", "-", "é"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12).map("".join))
def test_candidates_against_all_pairs(text):
    base = pii.base_spans(text)
    assert pii.candidates(text, base) == plain_candidates(text, base)


def test_added_spans_against_a_plain_run(spark, sample):
    """Votes of all documents counted in one loop, the label model and the classifier on them, every candidate asked."""
    planted = [(10_000 + i, f"token = {hashlib.sha1(str(i).encode()).hexdigest()} of James Smith, ssn 123-45-{1000 + i}, call 020 7946 {1000 + i}, order {'z9' * 12}") for i in range(30)]  # noqa: S324
    df = sample[0].union(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted], sample[0].schema))
    rows = df.collect()
    seen = Counter()
    for r in rows:
        t = r["text"] or ""
        for k, s, e in plain_candidates(t, brute(t)):
            seen[k, pii.votes(t, k, s, e), pii.traits(t, s, e)] += 1
    keys = sorted(seen, key=lambda x: (x[0], ",".join(map(str, x[1])), ",".join(map(str, x[2]))))
    patterns, counts = np.array([k[1] for k in keys]), np.array([seen[k] for k in keys], float)
    posterior, _, _ = pii.expectation_maximisation(patterns, counts)
    classifier = pii.fit(np.array([k[0] for k in keys]), patterns, np.array([k[2] for k in keys]), counts, posterior)
    for r in pii.detect(spark, df).collect():
        t = next(x["text"] for x in rows if x["doc_id"] == r["doc_id"]) or ""
        added = [(k, s, e) for k, s, e in plain_candidates(t, brute(t)) if classifier.accepts(k, pii.votes(t, k, s, e), pii.traits(t, s, e))]
        assert r["spans"] == pii.joined(brute(t) + sorted(added))


def test_the_classifier_learns_from_traits():
    """Candidates with the same votes, told apart by their length alone."""
    vote, short, long = (0, 0, 0, 0, 1), (0, 2, 0, 3, 0), (4, 2, 0, 3, 0)
    kind = pii.KINDS.index("secret")
    c = pii.fit(np.array([kind, kind]), np.array([vote, vote]), np.array([short, long]), np.array([50.0, 50.0]), np.array([0.05, 0.95]))
    assert c.accepts(kind, vote, long) and not c.accepts(kind, vote, short)


def test_many_candidates_take_linear_time():
    text = "James Smith x.y@example.org, " * 30_000
    found = pii.candidates(text, pii.base_spans(text))
    assert len(found) == 30_000


def test_luhn_and_bank_numbers():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.iban_ok("DE89 3704 0044 0532 0130 00") and not pii.iban_ok("DE88 3704 0044 0532 0130 00")


def test_long_secrets_are_found_whole(spark, documents):
    import random

    rng = random.Random(5)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    word = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(i, f"some words here token = {run('0123456789abcdef', n)} and more") for i, n in enumerate([40] * 12 + [128, 129, 256, 4096])]
    rows += [(20 + i, f"the bearer eyJ{run(word, n)} is sent") for i, n in enumerate((100, 200, 1000))]
    got = {r["doc_id"]: r["spans"] for r in pii.detect(spark, documents(rows)).collect()}
    for i, t in rows:
        start = t.index("eyJ") if i >= 20 else t.index("= ") + 2
        assert f"secret:{start}:{t.index(' ', start)}" in got[i], (i, got[i])
    text = "key " + "a1/+" * 200_000
    assert pii.candidates(text, []) == [(pii.KINDS.index("secret"), 4, len(text))]
