"""URL filter: allow and block rules, else gradient-boosted trees on lexical features.

All of it is DataFrame and SQL expressions. Features: lengths, depths, digit ratios, hyphens, entropy of the host,
parameters, and statistics of labelled URLs: the block rates of the host's last label, of its last two, and the mean
rate of its runs of four characters. Rates are kept in BUCKETS hash buckets, so that every suffix and run counts and the
model's size does not depend on the URLs. They come from one half of the labelled URLs, and the trees from the other, which
therefore learn how far rates can be trusted on hosts not seen before. The trees are trained by the JVM's gradient
boosting and then written out as one CASE expression a tree, so that scoring has no model object on the way.

Labelled URLs: any (url, label 0/1) DataFrame. ``labelled_urls`` makes the built-in one by rule: both labels have names of
words, of syllables, with and without hyphens and digits, all depths, suffixes and numbers of parameters, in
different shares, so that no feature parts them alone.

Defined results: a null url or one without :// has an empty host and path, no rule, and is allowed; a rule wins over the trees;
of several fitting rules the longest wins, of equally long ones the first given; repeated rows are judged alike; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (action, rule); a rule is a host and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "host_depth", "path_depth", "longest_label", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "parameters", "parameter_length", "encoded", "suffix_rate", "suffix2_rate", "gram_rate")
#: Hash buckets of each rate.
BUCKETS = 4096
GRAM = 4
#: Words of the built-in labelled URLs.
BAD_WORDS = ("cheap", "pills", "casino", "win", "free", "bets", "adult", "ads", "track", "spam", "farm", "xxx", "loan", "bonus", "viagra", "poker", "slots", "click", "prize", "deal", "crypto", "girls", "hot", "replica")
GOOD_WORDS = ("news", "city", "garden", "science", "music", "school", "library", "travel", "kitchen", "history", "health", "river", "museum", "theatre", "weather", "forest", "college", "review", "atlas", "nature", "village", "market", "letters", "journal")
SYLLABLES = ("an", "ber", "co", "de", "el", "fa", "gi", "hol", "in", "ka", "lo", "mar", "ne", "on", "pe", "ra", "san", "th", "ti", "ul", "va", "wen", "er", "st")
#: Suffixes of the built-in labelled URLs; those further to the front are the more frequent ones of their label.
GOOD_SUFFIXES = ("com", "org", "net", "example.com", "example.org", "example.net", "de", "fr", "es", "edu", "co.uk", "info")
BAD_SUFFIXES = ("com", "net", "example.com", "info", "example.net", "xyz", "top", "example.org", "biz", "org", "click", "de")


def host(url: str = "url") -> Column:
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    return F.coalesce(F.when(F.instr(F.col(url), "://") > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)), F.lit(""))


def path(url: str = "url") -> Column:
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    return F.coalesce(F.when(F.instr(F.col(url), "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def labelled_urls(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Built-in labelled URLs, every third one to block, made from the lists above by the row's number."""

    def draw(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))

    def pick(words: tuple[str, ...], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (draw(salt, len(words)) + 1).cast("int"))

    def front(words: tuple[str, ...], salt: int) -> Column:
        """One of the words, the earlier the likelier."""
        return F.element_at(F.array(*map(F.lit, words)), (F.least(draw(salt, len(words)), draw(salt + 1, len(words))) + 1).cast("int"))

    def one_of(salt: int, *options: tuple[int, Column]) -> Column:
        """One of the options by their shares."""
        upto = sum(n for n, _ in options) - options[-1][0]
        at, out = draw(salt, upto + options[-1][0]), options[-1][1]
        for n, option in reversed(options[:-1]):
            out = F.when(at >= upto, out).otherwise(option)
            upto -= n
        return out

    def number(salt: int, most: int) -> Column:
        return draw(salt, most).cast("string")

    def by_label(bad: Column, good: Column) -> Column:
        return F.when(F.col("label") == 1, bad).otherwise(good)

    noise = F.concat(*[pick(SYLLABLES, 20 + i) for i in range(2)], one_of(23, (2, F.lit("")), (1, pick(SYLLABLES, 24)), (1, F.concat(pick(SYLLABLES, 25), pick(SYLLABLES, 26)))))
    bad, other, good, second = pick(BAD_WORDS, 2), pick(BAD_WORDS, 3), pick(GOOD_WORDS, 4), pick(GOOD_WORDS, 5)
    scrambled = F.concat(F.substring(F.md5(F.concat(F.lit("u"), F.col("id").cast("string"))), 1, 7), F.substring(F.sha1(F.col("id").cast("string")), 1, 5))
    bad_name = one_of(1, (6, F.concat(bad, F.lit("-"), other)), (6, F.concat(bad, other)), (3, F.concat(bad, good)), (2, F.concat(bad, F.lit("-"), other, F.lit("-"), good)), (2, F.concat(bad, number(6, 1000))), (2, F.concat(noise, F.lit("-"), bad)), (4, scrambled), (4, noise), (2, F.concat(good, second)))
    good_name = one_of(1, (10, noise), (4, F.concat(good, second)), (4, F.concat(good, F.lit("-"), second)), (2, F.concat(noise, F.lit("-"), good)), (1, F.concat(good, F.lit("-"), second, F.lit("-"), noise)), (3, good), (2, F.concat(good, number(6, 1000))), (3, F.concat(bad, good)), (1, scrambled))
    plain = one_of(7, (4, F.lit("")), (3, F.lit("www.")), (2, F.lit("blog.")), (2, F.lit("m.")), (1, F.concat(noise, F.lit("."))))
    deeper = F.concat(pick(SYLLABLES, 30), number(31, 90), F.lit("."), pick(SYLLABLES, 32), F.lit("."))
    before = by_label(one_of(33, (4, plain), (1, deeper)), one_of(33, (19, plain), (1, deeper)))
    name = F.concat(before, by_label(bad_name, good_name), F.lit("."), by_label(front(BAD_SUFFIXES, 34), front(GOOD_SUFFIXES, 34)))
    usual = one_of(11, (6, F.concat(F.lit("/"), pick(("en", "fr", "de", "es"), 12), F.lit("/"), number(13, 60000))), (2, F.concat(F.lit("/"), pick(GOOD_WORDS, 14))), (2, F.concat(F.lit("/"), number(15, 2030), F.lit("/"), pick(GOOD_WORDS, 16), F.lit(".html"))), (1, F.lit("/")))
    nested = F.concat(F.lit("/"), pick(SYLLABLES, 40), F.lit("/"), pick(BAD_WORDS, 41), F.lit("/"), number(42, 10**9), F.lit("/"), pick(GOOD_WORDS, 43), F.lit("%20"), pick(SYLLABLES, 44))
    where = by_label(one_of(45, (3, usual), (1, nested)), one_of(45, (14, usual), (1, nested)))
    few = one_of(17, (4, F.lit("")), (1, F.lit("?utm_source=feed")), (1, F.concat(F.lit("?page="), number(18, 90), F.lit("&ref=x"))), (1, F.lit("/")))
    many = F.concat(F.lit("?id="), number(46, 10**8), F.lit("&"), pick(SYLLABLES, 47), F.lit("="), pick(BAD_WORDS, 48), F.lit("&aff="), number(49, 10**6), F.lit("&sub="), pick(SYLLABLES, 50))
    query = by_label(one_of(51, (3, few), (1, many)), one_of(51, (14, few), (1, many)))
    label = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    return spark.range(rows).withColumn("label", label).select(F.concat(one_of(8, (1, F.lit("https://")), (1, F.lit("http://"))), name, where, query).alias("url"), "label")


def lexical(df: DataFrame) -> DataFrame:
    """Adds host, path and the lexical features but the suffix rates, in a struct column ``f``."""
    df = df.withColumn("host", host()).withColumn("path", path())
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split("host", r"\.")
    chars = F.split("host", "")
    n = F.length("host")
    entropy = F.when(n > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))).otherwise(F.lit(0.0))
    columns = {
        "url_length": F.length(url),
        "host_length": n,
        "path_length": F.length("path"),
        "host_depth": F.when(n > 0, F.size(labels)).otherwise(0),
        "path_depth": F.length("path") - F.length(F.replace(F.col("path"), F.lit("/"))),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "digit_ratio": ratio(digits(url), F.length(url)),
        "host_digit_ratio": ratio(digits(F.col("host")), n),
        "hyphens": n - F.length(F.replace(F.col("host"), F.lit("-"))),
        "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(1 + F.length(query) - F.length(F.replace(query, F.lit("&")))),
        "parameter_length": F.length(query),
        "encoded": F.length(url) - F.length(F.replace(url, F.lit("%"))),
    }
    return df.withColumn("f", F.struct(*[v.cast("double").alias(k) for k, v in columns.items()]))


def suffix(depth: int) -> Column:
    return F.substring_index("host", ".", -depth)


def grams() -> Column:
    """The host's runs of GRAM characters; one shorter run of a shorter host."""
    chars = F.split("host", "")
    last = F.greatest(F.size(chars) - GRAM + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda at: F.concat(*[F.coalesce(F.get(chars, at + (j - 1)), F.lit("")) for j in range(GRAM)]))


def bucket(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class UrlModel:
    """One SQL expression over the features, above 0 for a URL to block, and the block rates of each bucket: of the
    last label, the last two, and the runs of characters."""

    margin: str
    rates: tuple[tuple[float, ...], ...]


def _tree_sql(debug: str, names: tuple[str, ...]) -> str:
    """A regression tree's text form as nested CASE expressions."""
    lines = [x.strip() for x in debug.splitlines() if re.match(r"\s*(If|Else|Predict)", x)]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if m := re.match(r"Predict: (\S+)", line):
            return f"{float(m[1])!r}D"
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
        left = node()
        at += 1  # Else
        return f"CASE WHEN {names[int(m[1])]} <= {float(m[2])!r}D THEN {left} ELSE {node()} END"

    return node()


def _with_rates(df: DataFrame, rates: tuple[tuple[float, ...], ...]) -> DataFrame:
    tables = [F.expr(f"array({', '.join(f'{v!r}D' for v in r)})") for r in rates]  # parsed at once; a call a number takes seconds
    rate = lambda k, value: F.element_at(tables[k], bucket(value) + 1)
    runs = grams()
    mean = F.aggregate(F.transform(runs, lambda g: rate(2, g)), F.lit(0.0), lambda acc, r: acc + r) / F.size(runs)
    return df.withColumns({name: F.col(f"f.{name}") for name in FEATURES[:-3]} | {"suffix_rate": rate(0, suffix(1)), "suffix2_rate": rate(1, suffix(2)), "gram_rate": mean})


def block_rates(sample: DataFrame, prior: float, weight: float = 5.0) -> tuple[tuple[float, ...], ...]:
    """Smoothed block rates by bucket: at most BUCKETS rows a table come to the driver."""
    out = []
    for values in (F.array(suffix(1)), F.array(suffix(2)), F.array_distinct(grams())):
        per = sample.select("label", F.explode(values).alias("v")).groupBy(bucket(F.col("v")).alias("b")).agg(F.sum("label").alias("bad"), F.count("*").alias("n")).collect()
        table = [prior] * BUCKETS
        for r in per:
            table[r["b"]] = (r["bad"] + weight * prior) / (r["n"] + weight)
        out.append(tuple(table))
    return tuple(out)


def train(spark: SparkSession, labelled: DataFrame, *, max_rows: int = 50_000, trees: int = 16, depth: int = 4) -> UrlModel:
    """Learn from at most max_rows labelled URLs, those with the smallest hash."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    sample = lexical(labelled.select("url", F.col("label").cast("double").alias("label")).where("label in (0, 1)").orderBy(F.xxhash64("url"), "url").limit(max_rows)).persist()
    half = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2))
    low = {r["h"]: r for r in sample.groupBy(half.alias("h")).agg(F.avg("label").alias("p"), F.min("label").alias("low"), F.max("label").alias("high")).collect()}
    if not low or low.get(1, {"low": 0, "high": 0})["low"] == low.get(1, {"low": 0, "high": 0})["high"]:
        only = {r["high"] for r in low.values()}
        sample.unpersist()
        return UrlModel("1.0D" if only == {1.0} else "-1.0D", ((0.5,) * BUCKETS,) * 3)
    rates = block_rates(sample.where(half == 0), low[0]["p"] if 0 in low else 0.5)
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_with_rates(sample.where(half == 1), rates)).select("features", "label").coalesce(1)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=11, stepSize=0.3).fit(ready)
    sample.unpersist()
    terms = [f"{w!r}D * ({_tree_sql(t.toDebugString, FEATURES)})" for w, t in zip(model.treeWeights, model.trees, strict=True)]
    return UrlModel(" + ".join(terms), rates)


def rule_for(rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The action and text of the longest fitting rule, as a struct; null if none fits."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule in sorted(reversed(rules), key=lambda x: len(x[1])):  # the last that fits wins
        name, slash, rest = rule.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def judge(pages: DataFrame, model: UrlModel, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, margin of every row of ``pages`` (page_id, url)."""
    df = _with_rates(lexical(pages.select("page_id", "url")), model.rates)
    df = df.withColumn("margin", F.expr(model.margin)).withColumn("r", rule_for(rules))
    own = F.when((F.col("host") != "") & (F.col("margin") > 0), "block").otherwise("allow")
    return df.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.action", own).alias("verdict"), "margin")
