"""URL verdicts: rules first, then words segmented out of host names, scored by multinomial naive Bayes.

Host labels are concatenated words: a unigram Viterbi search splits them into the words of the pages' own texts. Each
name is joined with the words that occur within it, so no vocabulary is cut. The tokens of host and path then go into a multinomial naive Bayes model whose classes are allow and block. It learns
from the pages that a rule decides and from a few seed words, which count as pseudo-observations.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_arrow, materialize, text_bytes

#: (host, path without its first slash, verdict)
RULES = (("com", "en/", "block"), ("example.com", "en/7", "allow"), ("net", "de/", "allow"), ("example.net", "de/8", "block"), ("org", "es/", "block"))
#: Words that point to advertising, fraud or adult pages, and words that point to ordinary ones.
BLOCK_WORDS = ("spam", "farm", "cheap", "pills", "casino", "bet", "poker", "viagra", "loan", "adult", "xxx", "porn", "click", "winner", "prize", "free", "crack", "warez", "replica", "escort")
ALLOW_WORDS = ("blog", "news", "wiki", "docs", "edu", "library", "science", "school", "journal", "help")
COMMON = frozenset(("www", "m", "com", "net", "org", "html", "example"))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) columns: host after the first :// up to / ? # or the end, A-Z lower-cased; path up to ? or #."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a domain above it and whose path begins the url's; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(f"{h}/{p}")).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def segment(name: str, words: dict[str, float], unknown: float, longest: int = 20) -> list[str]:
    """The likeliest split of a name into words (log probabilities); an unknown stretch costs `unknown` a letter and once more."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        choice = (-math.inf, 0)
        for start in range(max(0, end - longest), end):
            w = name[start:end]
            s = best[start][0] + words.get(w, unknown * (end - start + 1))
            if s > choice[0]:
                choice = (s, start)
        best.append(choice)
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def names(host: str, path: str) -> list[tuple[str, str, bool]]:
    """(side, name, whether it is to be split) of host labels and path pieces, in order; common names of paths go."""
    out = []
    for label in re.split(r"[^a-z0-9]+", host):
        if label and label not in COMMON:
            out.append(("h:", label, True))
    for bit in re.split(r"[^a-z0-9]+", path.lower()):
        if bit.isdigit():
            out.append(("p:", "#", False))
        elif bit and bit not in COMMON:
            out.append(("p:", bit, True))
    return out


def _name_rows(batches: Iterator[pa.RecordBatch]):
    """The names of each row, numbered in order."""
    for b in batches:
        own = [(r, k, *n) for r, h, p in zip(*(c.to_pylist() for c in b.columns[:3])) for k, n in enumerate(names(h, p))]
        cols = list(zip(*own)) or [()] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_()))], ["row", "at", "side", "name", "whole"])


def _stretches(batches: Iterator[pa.RecordBatch]):
    """Every stretch of 2 to 20 letters of each name, as far as it can be a word."""
    for b in batches:
        for name in b.column(0).to_pylist():
            found: set[str] = set()
            for run in re.findall(r"[a-z]{2,}", name):
                found.update(run[k : k + n] for k in range(len(run) - 1) for n in range(2, min(20, len(run) - k) + 1))
            every = list(found)
            for k in range(0, len(every), 100_000):
                part = every[k : k + 100_000]
                yield pa.record_batch([pa.array([name] * len(part), pa.string()), pa.array(part, pa.string())], ["name", "word"])


def _split_rows(unknown: float):
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            words = [{x["word"]: x["logp"] for x in own or ()} for own in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([segment(n, w, unknown) for n, w in zip(b.column(0).to_pylist(), words)], pa.list_(pa.string()))], ["name", "pieces"])

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]):
    seen: Counter = Counter()
    for b in batches:
        for t in text_bytes(b.column(0)):
            if t:
                seen.update(re.findall(rb"[a-z]+", re.sub(rb"<[^>]*>", b" ", t).lower()))
        if len(seen) > 500_000:
            yield pa.record_batch([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "times"])
            seen = Counter()
    yield pa.record_batch([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "times"])


def word_model(pages: DataFrame, html_col: str = "html", seeds: tuple[str, ...] = BLOCK_WORDS + ALLOW_WORDS) -> tuple[DataFrame, float]:
    """(word, logp): log probabilities of all words of all pages' texts (2 to 20 letters), seed words included; and the cost of an unknown letter."""
    spark = pages.sparkSession
    counts = materialize(map_arrow(pages.select(F.col(html_col).cast("string")), _word_counts, "word string, times long").where("length(word) between 2 and 20").groupBy("word").agg(F.sum("times").alias("times")), "words")
    floor = max(1, (counts.agg(F.sum("times")).first()[0] or 0) // 100_000)
    known = counts.unionByName(spark.createDataFrame([(w, floor) for w in seeds], "word string, times long")).groupBy("word").agg(F.max("times").alias("times"))
    total, least = known.agg(F.sum("times"), F.min("times")).first()
    return known.select("word", F.log(F.col("times") / F.lit(float(total))).alias("logp")), math.log(least / total) - 2.0


def split_names(own: DataFrame, words: DataFrame, unknown: float) -> DataFrame:
    """(name, pieces) of the distinct names in own: each meets the words that occur within it, whatever their number."""
    x = own.where("whole").select("name").distinct()
    hits = map_arrow(x, _stretches, "name string, word string").join(words, "word").groupBy("name").agg(F.collect_list(F.struct("word", "logp")).alias("words"))
    return map_arrow(x.join(hits, "name", "left").select("name", "words"), _split_rows(unknown), "name string, pieces array<string>")


def token_rows(rows: DataFrame, words: DataFrame, unknown: float) -> DataFrame:
    """(row, at, k, token): all tokens of rows (row, host, path), in order by at and k."""
    own = materialize(map_arrow(rows.select("row", "host", "path"), _name_rows, "row long, at int, side string, name string, whole boolean"), "names")
    pieces = materialize(split_names(own, words, unknown), "pieces")
    split = own.join(pieces, "name", "left").select("row", "at", "side", F.posexplode(F.coalesce("pieces", F.array("name"))).alias("k", "w"))
    return split.where(~F.col("w").isin(*COMMON) | (F.col("side") == "p:")).select("row", "at", "k", F.concat("side", "w").alias("token"))


def token_odds(tokens: DataFrame, verdicts: DataFrame, seed_weight: float = 50.0) -> tuple[DataFrame, float]:
    """(token, odds): naive Bayes log odds of block of every token of decided rows and of the seed words; and those of any other token."""
    seeds = [(f"{side}:{w}", seed_weight * (k == 0), seed_weight * (k == 1)) for k, own in enumerate((BLOCK_WORDS, ALLOW_WORDS)) for w in own for side in ("h", "p")]
    side = lambda v: F.sum((F.col("verdict") == v).cast("double")).alias(v)
    counts = tokens.join(verdicts, "row").groupBy("token").agg(side("block"), side("allow"))
    counts = materialize(counts.unionByName(tokens.sparkSession.createDataFrame(seeds, "token string, block double, allow double")).groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "odds")
    n, block, allow = counts.agg(F.count(F.lit(1)), F.sum("block"), F.sum("allow")).first()
    unseen = math.log(allow + n + 1) - math.log(block + n + 1)
    return counts.select("token", (F.log(F.col("block") + 1) - F.log(F.col("allow") + 1) + F.lit(unseen)).alias("odds")), unseen


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES) -> DataFrame:
    """Return (id_col, host, path, rule, verdict, tokens, log_odds), one row per input row.

    The longest rule that fits decides; elsewhere the naive Bayes log odds do (block above 0);
    they begin with the log odds of the classes among rule-decided pages. Null urls and urls
    without :// have an empty host and path, no tokens and the verdict allow. Ids may be null or repeat; html may be
    null. An empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    host, path = parts(F.col(url_col).cast("string"))
    x = pages.select(F.col(id_col).alias("_mr_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    x = materialize(x.select(F.monotonically_increasing_id().alias("row"), "*").select("*", rule.alias("rule"), verdict.alias("ruled")), "urls")
    words, unknown = word_model(pages, html_col)
    tokens = materialize(token_rows(x, words, unknown), "tokens")
    ruled = x.where("ruled is not null").select("row", F.col("ruled").alias("verdict"))
    odds, unseen = token_odds(tokens, ruled)
    block, allow = ruled.agg(F.count(F.when(F.col("verdict") == "block", 1)), F.count(F.when(F.col("verdict") == "allow", 1))).first()
    prior = math.log((block + 1) / (allow + 1))
    scored = tokens.join(odds, "token", "left").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "k", "token"))), lambda t: t["token"]).alias("tokens"), (F.sum(F.coalesce("odds", F.lit(unseen))) + F.lit(prior)).alias("log_odds"))
    out = x.join(scored, "row", "left").withColumn("log_odds", F.coalesce("log_odds", F.lit(0.0)))
    return out.select(F.col("_mr_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "log_odds")
