"""Personal data by weak supervision.

Base spans follow fixed patterns (email, ip, card, phone) and always stay. Further candidates come from loose
patterns (secrets, national ids, local phone numbers, account numbers, names). On each candidate a set of
labelers votes yes, no or nothing: format patterns, a gazetteer, words before the span, and character statistics. Expectation-maximisation over the counts
of vote patterns estimates how reliable each labeler is, without any labels. Its posteriors are the soft labels of a
logistic span classifier, which sees what the labelers do not: beside votes and kind the candidate's binned traits (length,
shares of digits and capitals, entropy, the characters around it). Candidates it accepts become spans. Only
counts of vote and trait patterns, a bounded set, reach the driver.

Defined results: a null text has no spans; overlapping candidates go to the base spans first, then to the leftmost,
then to the longest; repeated rows are judged alike; without any candidate the classifier accepts nothing; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilescape.llm.common import bound_batches, texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "name", "national_id", "secret")
KINDS = BASE + ADDED

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits that fails at its start fails at every later place, so only starts are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Words before a span that speak for its kind, and words that speak against any.
CONTEXT = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "key", "bearer", "auth", "credential"),
    "national_id": ("ssn", "social", "security", "passport", "national", "id", "dni", "nif", "insee", "steuer"),
    "account": ("phone", "tel", "telephone", "call", "mobile", "fax", "account", "iban", "konto", "telefon", "compte", "cuenta"),
    "name": ("name", "mr", "mrs", "ms", "dr", "dear", "contact", "from", "by", "monsieur", "madame", "herr", "frau", "señor", "señora"),
}
AGAINST = ("isbn", "issn", "version", "order", "page", "figure", "table", "chapter", "commit", "sha", "md5", "build", "part", "lot", "doi")
#: Given names of the gazetteer: common ones in the languages of the context words.
GIVEN = ("James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth", "David", "Barbara", "Richard", "Susan", "Thomas", "Sarah", "Karen", "Charles", "Nancy", "Daniel", "Lisa", "Matthew", "Anthony", "Margaret", "Sandra", "Ashley", "Steven", "Emily", "Andrew", "Donna", "Michelle", "Joshua", "Carol", "Kevin", "Amanda", "Brian", "Melissa", "George", "Deborah", "Pierre", "Marie", "Jean", "Claude", "Sophie", "Hans", "Klaus", "Jürgen", "Ursula", "Heike", "José", "María", "Carlos", "Carmen", "Javier", "Ana", "Joseph", "Christopher", "Mark", "Donald", "Paul", "Kenneth", "Edward", "Jason", "Ryan", "Jacob", "Nicholas", "Eric", "Jonathan", "Stephen", "Larry", "Justin", "Scott", "Brandon", "Benjamin", "Samuel", "Frank", "Gregory", "Raymond", "Alexander", "Patrick", "Jack", "Dennis", "Jerry", "Peter", "Susan", "Jessica", "Betty", "Helen", "Kimberly", "Laura", "Stephanie", "Rebecca", "Cynthia", "Kathleen", "Amy", "Angela", "Anna", "Ruth", "Virginia", "Rachel", "Catherine", "Christine", "Samantha", "Julie", "Emma", "Olivia", "Sophia", "François", "Michel", "Nicolas", "Julien", "Camille", "Chloé", "Isabelle", "Nathalie", "Thierry", "Luc", "Peter", "Wolfgang", "Stefan", "Andreas", "Markus", "Sabine", "Monika", "Petra", "Katrin", "Anja", "Antonio", "Manuel", "Francisco", "Luis", "Miguel", "Pedro", "Lucía", "Isabel", "Pilar", "Rosa", "Elena", "Laura")
#: Prefixes of well-known credentials, and country codes of bank account numbers.
KNOWN_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ")
IBAN_COUNTRIES = ("DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "PT", "IE", "LU")

_CANDIDATES = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+")),
    ("national_id", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![0-9A-Za-z.])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])")),
    ("name", re.compile(r"\b(?:" + "|".join(sorted(set(GIVEN))) + r") (?:[A-Z]\. )?[A-Z][a-zà-ÿ]+\b")),
)
LABELERS = ("pattern", "gazetteer", "context", "against", "statistics")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start. Each kind: leftmost matches without overlap, failing ones dropped."""
    out = []
    at = text.find("@")
    done = 0
    while at >= 0:
        # the local part may not reach into the match before; no class of the pattern but the sign itself holds @
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((3, *m.span()))
    return out


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of further candidates, without overlap among themselves or with ``taken``."""
    found = []
    for kind, pattern in _CANDIDATES:
        for m in pattern.finditer(text):
            if kind == "secret" and not (_DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0])):
                continue
            found.append((m.start(), -m.end(), KINDS.index(kind)))
    if not found:
        return []
    out, last, at = [], 0, 0
    busy: list[list[int]] = []  # the taken spans, those that overlap as one
    for s, e in sorted((s, e) for _, s, e in taken):
        if busy and s < busy[-1][1]:
            busy[-1][1] = max(busy[-1][1], e)
        else:
            busy.append([s, e])
    for start, end, kind in sorted(found):  # starts only grow, so that both lists are passed once
        end = -end
        while at < len(busy) and busy[at][1] <= start:
            at += 1
        if start >= last and (at == len(busy) or busy[at][0] >= end):
            out.append((kind, start, end))
            last = end
    return out


#: Number of values of each trait.
TRAITS = (6, 5, 3, 5, 4)


def traits(text: str, start: int, end: int) -> tuple[int, ...]:
    """Binned length, share of digits, share of capitals, entropy, and what stands around: one value for each of TRAITS."""
    span = text[start:end]
    n = len(span)
    counts = Counter(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digits, capitals = sum(map(str.isdigit, span)), sum(map(str.isupper, span))
    before, after = text[start - 1 : start], text[end : end + 1]
    around = 2 * (before in ("=", ":", '"', "'", "(", "<", "[")) + (after in ('"', "'", ")", ">", "]", ",", ".", ";", ""))
    return min(5, n.bit_length() - 3) if n >= 8 else 0, min(4, 5 * digits // n), min(2, 3 * capitals // n), min(4, int(entropy)), around


def votes(text: str, kind: int, start: int, end: int) -> tuple[int, ...]:
    """One vote for each of LABELERS: 1 yes, -1 no, 0 none."""
    span, name = text[start:end], KINDS[kind]
    before = re.findall(r"[^\W_][\w]*", text[max(0, start - 40) : start].lower())[-4:]
    digits = sum(c.isdigit() for c in span)
    if name == "secret":
        pattern = 1 if re.fullmatch(r"[0-9a-f]{32,}|[A-Z0-9]{20}|[A-Za-z0-9_-]{32,}", span) else 0
        gazetteer = 1 if span.startswith(KNOWN_PREFIXES) else 0
    elif name == "national_id":
        pattern = -1 if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else 1
        gazetteer = 0
    elif name == "account":
        pattern = 1 if span[:2].isalpha() and iban_ok(span) else 0
        gazetteer = 1 if span.startswith(IBAN_COUNTRIES) else 0
    else:
        pattern, gazetteer = 0, 1
    context = 1 if any(w in CONTEXT[name] for w in before) else (-1 if before and name in ("account", "name") else 0)
    against = -1 if any(w in AGAINST for w in before) else 0
    counts = Counter(span)
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in counts.values())
    if name == "secret":
        statistics = 1 if entropy >= 3.3 and digits * 5 >= len(span) and digits * 10 <= 9 * len(span) else -1
    elif name == "name":
        statistics = 0
    else:
        statistics = -1 if len(counts) <= 3 else 0
    return pattern, gazetteer, context, against, statistics


def iban_ok(span: str) -> bool:
    s = span.replace(" ", "")
    return s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors of the vote patterns, reliabilities p[labeler, truth, vote + 1], and the share of yes.

    Dawid-Skene with votes -1, 0, 1; pseudo-counts keep every probability above zero. It starts from the sum of votes.
    """
    q = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1) + 0.5))
    p = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        share = float((counts * q).sum() + 1) / float(counts.sum() + 2)
        for j in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                at = patterns[:, j] == v
                for truth, w in ((1, q), (0, 1 - q)):
                    prior = 2.0 if v == (1 if truth else -1) else 1.0
                    p[j, truth, v + 1] = (counts * w)[at].sum() + prior
        p /= p.sum(axis=2, keepdims=True)
        like = np.log([1 - share, share])[None, :].repeat(len(patterns), 0)
        for j in range(patterns.shape[1]):
            like += np.log(p[j, :, patterns[:, j] + 1])
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -50, 50)))
        if np.abs(new - q).max() < 1e-7:
            break
        q = new
    return q, p, share


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic regression over kind, and one-hot votes and traits."""

    weights: tuple[float, ...]
    threshold: float = 0.5

    @staticmethod
    def row(kind: int, vote: tuple[int, ...], trait: tuple[int, ...]) -> list[float]:
        x = [1.0] + [float(kind == k) for k in range(len(BASE), len(KINDS))]
        for v in vote:
            x += [float(v == 1), float(v == -1)]
        for v, n in zip(trait, TRAITS, strict=True):
            x += [float(v == k) for k in range(n)]
        return x

    def accepts(self, kind: int, vote: tuple[int, ...], trait: tuple[int, ...]) -> bool:
        z = sum(w * x for w, x in zip(self.weights, self.row(kind, vote, trait), strict=True))
        return z > math.log(self.threshold / (1 - self.threshold))


def fit(kinds: np.ndarray, patterns: np.ndarray, seen: np.ndarray, counts: np.ndarray, posterior: np.ndarray, l2: float = 1.0) -> SpanClassifier:
    """Newton's method on soft labels."""
    x = np.array([SpanClassifier.row(int(k), tuple(v), tuple(t)) for k, v, t in zip(kinds, patterns, seen, strict=True)])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (counts * (p - posterior)) + l2 * w
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return SpanClassifier(tuple(float(v) for v in w))


def _votes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("kind", pa.int32()), ("votes", pa.string()), ("traits", pa.string()), ("n", pa.int64())])
    seen: Counter = Counter()
    for batch in it:
        for t in texts(batch):
            if t:
                for kind, s, e in candidates(t, base_spans(t)):
                    seen[kind, ",".join(map(str, votes(t, kind, s, e))), ",".join(map(str, traits(t, s, e)))] += 1
    keys = list(seen)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), *(pa.array([k[i] for k in keys], pa.string()) for i in (1, 2)), pa.array(list(seen.values()), pa.int64())], schema=schema)


def train(spark: SparkSession, docs: DataFrame) -> SpanClassifier:
    """Votes over all documents; their counts by pattern come to the driver: at most len(ADDED) * 3 ** len(LABELERS)
    times the product of TRAITS, in practice hundreds of rows, however many documents there are."""
    bound_batches(spark)
    counted = docs.select("text").mapInArrow(_votes, "kind int, votes string, traits string, n long").groupBy("kind", "votes", "traits").agg(F.sum("n").alias("n"))
    rows = counted.collect()
    if not rows:
        return SpanClassifier(tuple([-1.0] + [0.0] * (len(ADDED) + 2 * len(LABELERS) + sum(TRAITS))))
    rows.sort(key=lambda r: (r["kind"], r["votes"], r["traits"]))
    kinds = np.array([r["kind"] for r in rows])
    patterns, seen = (np.array([[int(v) for v in r[c].split(",")] for r in rows]) for c in ("votes", "traits"))
    counts = np.array([r["n"] for r in rows], float)
    posterior, _, _ = expectation_maximisation(patterns, counts)
    return fit(kinds, patterns, seen, counts, posterior)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, classifier: SpanClassifier) -> DataFrame:
    """doc_id, base (spans of the base kinds) and spans (all of them), each as kind:start:end by kind and start."""
    names, kinds = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"], [pa.int64()] * 4 + [pa.string()] * 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols: list[list] = [[] for _ in kinds]
            for t in texts(batch):
                base = base_spans(t) if t else []
                more = [(k, s, e) for k, s, e in candidates(t, base) if classifier.accepts(k, votes(t, k, s, e), traits(t, s, e))] if t else []
                for col, v in zip(cols, [*(sum(k == i for k, _, _ in base) for i in range(4)), joined(base), joined(base + sorted(more))], strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def detect(spark: SparkSession, docs: DataFrame) -> DataFrame:
    bound_batches(spark)
    return find(docs, train(spark, docs))


def redacted(text: str, spans: str, mask: Callable[[str], str] = lambda kind: f"<{kind}>") -> str:
    """The text with its spans (as ``find`` returns them) masked."""
    out, last = [], 0
    parts = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    for s, e, k in parts:
        if s >= last:
            out += [text[last:s], mask(k)]
        last = max(last, e)
    return "".join([*out, text[last:]])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
