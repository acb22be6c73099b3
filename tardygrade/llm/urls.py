"""Allow and block verdicts for urls.

Method. Rules decide first: the longest rule whose host is the url's host or a parent of it,
and whose path begins the url's path. All other urls are judged by their words. Host labels
and path parts are split into words by a unigram model: every part of a name that is a known
word of the pages has its relative frequency there, and a Viterbi pass takes the most
probable split. A multinomial naive Bayes model scores the words; it learns from the urls
themselves, of which those with a word of ``SEEDS`` count as examples to block.

Word counts, splits and scores are joins and aggregations: names are split once each,
however many urls have them, and a frequent host or word is counted before it is shuffled.

Names of any length are split whole; very long names and texts cost time in proportion to
their length. Further columns of ``pages`` are ignored, whatever their names.

Results. Null urls, and urls without ``://``, have an empty host and path and no words, so
no rule fits and they are allowed. Repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that mark a name as unwanted.
SEEDS = (
    "ads", "adult", "bet", "bets", "betting", "bonus", "casino", "cheap", "clickbait", "crack", "dating", "escort",
    "free", "gamble", "gambling", "hack", "jackpot", "keygen", "loan", "loans", "lottery", "malware", "nude", "payday",
    "phish", "pharmacy", "pills", "poker", "porn", "replica", "scam", "sex", "slots", "spam", "torrent", "track",
    "tracker", "viagra", "warez", "win", "xxx",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class Settings:
    longest_word: int = 24
    smoothing: float = 1.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; block wins a tie."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def name_parts(host: Column, path: Column) -> Column:
    """Runs of letters in host and path, in lower case; scheme words and file endings among them."""
    return F.regexp_extract_all(F.lower(F.concat(host, F.lit("/"), path)), F.lit(r"(\p{L}+)"), 1)


# Splitting names --------------------------------------------------------------


def best_split(name: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """Most probable words of a name; ``known`` has log-probabilities by start and length.

    A letter outside known words costs ``unknown`` and joins its neighbours in one word.
    Time grows with the length of the name times that of the longest known word in it.
    """
    longest = max((length for _, length in known), default=0)
    best = [(0.0, 0, False)] + [(-math.inf, 0, False)] * len(name)
    for start in range(len(name)):
        score = best[start][0]
        if score + unknown > best[start + 1][0]:
            best[start + 1] = (score + unknown, start, False)
        for length in range(1, min(longest, len(name) - start) + 1):
            own = known.get((start, length))
            if own is not None and score + own > best[start + length][0]:
                best[start + length] = (score + own, start, True)
    words, end = [], len(name)
    # Where the unknown letters end that begin at ``end``.
    until = end
    while end:
        _, start, is_known = best[end]
        if is_known:
            words += [name[end:until], name[start:end]] if until > end else [name[start:end]]
            until = start
        end = start
    return ([*words, name[:until]] if until else words)[::-1]


def word_counts(pages: DataFrame, text: str, s: Settings) -> DataFrame:
    """(word, n): words of all texts that can be part of a name."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), 1))
    words = pages.select(words.alias("word")).filter(F.length("word") <= s.longest_word)
    return words.groupBy("word").agg(F.count("*").alias("n"))


def split_names(names: DataFrame, counts: DataFrame, s: Settings) -> DataFrame:
    """(name, words) for every distinct ``name``."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    words, kinds = total[0] or 0, total[1] or 0
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    left = F.least(F.lit(s.longest_word), F.length("name") - F.col("start") + 1)
    parts = starts.select("name", "start", F.explode(F.sequence(F.lit(1), left)).alias("length"))
    parts = parts.withColumn("word", F.expr("substring(name, start, length)"))
    hits = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("start", "length", "n")).alias("hits"))
    both = names.join(hits, "name", "left")

    @F.arrow_udf("array<string>")
    def split(name: pa.Array, hits: pa.Array) -> pa.Array:
        size = math.log(words + kinds + 1)
        out = []
        for text, found in zip(name.to_pylist(), hits.to_pylist()):
            known = {(h["start"] - 1, h["length"]): math.log(h["n"]) - size for h in found or []}
            out.append(best_split(text, known, -size - math.log(10)))
        return pa.array(out, pa.list_(pa.string()))

    return both.select("name", split("name", "hits").alias("words"))


# Verdicts ---------------------------------------------------------------------


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, s: Settings = Settings()) -> DataFrame:
    """The rows of ``pages`` (page_id, url, html) with host, path, rule, words, log_odds and verdict."""
    host, path = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    # Equal hosts and paths have equal verdicts, so each is judged once.
    places = materialize(rows.groupBy("host", "path").agg(F.count("*").alias("n")), "places")
    named = places.select("host", "path", "n", F.explode(name_parts(F.col("host"), F.col("path"))).alias("name"))
    counts = materialize(word_counts(pages, "html", s), "words")
    split = materialize(split_names(named.select("name").distinct(), counts, s), "names")

    tokens = named.join(split, "name").select("host", "path", "n", F.explode("words").alias("word"))
    tokens = materialize(tokens.groupBy("host", "path", "n", "word").agg(F.count("*").alias("times")), "tokens")
    seeded = tokens.groupBy("host", "path", "n").agg(F.max(F.col("word").isin(*SEEDS)).alias("bad"))
    prior = seeded.agg(
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("bad"),
        F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n"))), F.lit(0)).alias("good"),
    ).first()
    weights = tokens.join(seeded.drop("n"), ["host", "path"]).groupBy("word").agg(
        F.sum(F.when(F.col("bad"), F.col("n") * F.col("times")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n") * F.col("times"))).alias("good"),
    )
    sums = weights.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()

    def share(column: str, total: int) -> Column:
        return F.log((F.col(column) + s.smoothing) / (total + s.smoothing * (sums[2] + 1)))

    weights = weights.select("word", (share("bad", sums[0]) - share("good", sums[1])).alias("weight"))
    start = math.log((prior["bad"] + 1) / (prior["good"] + 1))
    scores = tokens.join(weights, "word").groupBy("host", "path").agg(
        F.sum(F.col("weight") * F.col("times")).alias("log_odds"), F.sort_array(F.collect_list("word")).alias("words")
    )
    scores = places.join(scores, ["host", "path"], "left").select(
        "host", "path", "words", (F.coalesce("log_odds", F.lit(0.0)) + start).alias("log_odds")
    )
    rule = fresh(rows, "matched")
    out = rows.join(scores, ["host", "path"]).withColumn(rule, matching_rule(F.col("host"), F.col("path"), rules))
    no_words = F.col("words").isNull() | (F.col("log_odds") <= 0)
    return out.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col(f"{rule}.rule").alias("rule"),
        "words",
        "log_odds",
        F.coalesce(F.col(f"{rule}.verdict"), F.when(no_words, "allow").otherwise("block")).alias("verdict"),
    )
