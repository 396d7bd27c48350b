"""URL filters: rules for hosts and paths, and for the rest host word segmentation with multinomial naive Bayes.

Host labels and path parts are split into words by a unigram model (Viterbi over all segmentations; strings that are no
known word cost more the longer they are). The words' frequencies come from the pages themselves.

No table says which urls are bad, so naive Bayes over the segmented words is trained by expectation maximisation: pages with
a seed word are examples of the blocked class, and every other page belongs to both classes as far as the model of the
round before says. So words that go with seeds come to count, and pages that have only these are blocked. The verdict is
the last model's, which doesn't know the seeds: a seed among words of allowed pages doesn't block. Work is done on distinct
hosts and parts, under numbers, as they may be long; what belongs to pages is counted before it's shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, durable, skew_join

#: (action, host, path), fixed by the query's contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words that mark advertising, gambling, adult, spam and pill shops.
SEEDS = ("ads", "adult", "banner", "bet", "bets", "betting", "bingo", "casino", "gambling", "jackpot", "pills", "poker", "porn", "sex", "slots", "spam", "tracker", "viagra", "xxx")
#: Common words of host names, so that they're known whatever the pages hold.
COMMON = ("and", "best", "blog", "buy", "cheap", "click", "deals", "farm", "free", "live", "mail", "mobile", "news", "online", "page", "shop", "site", "the", "top", "track", "video", "web", "win", "www")
#: Probabilities that known words have beside their share of the pages, and that strings have that are no word: fixed, so that sizes change nothing.
KNOWN_SHARE, UNKNOWN_SHARE = 1e-4, 1e-5
LONGEST = 20
SMOOTHING = 1.0
#: Rounds of expectation maximisation after the one in which all other pages are allowed.
ROUNDS = 4
#: Bits of the map of hashes of what the parts hold: 64 to a row, so 262,144 rows at most are broadcast.
BITMAP_BITS = 1 << 24
#: Bytes up to which words' odds are sent to every task (they have LONGEST letters at most, or are one unknown string).
BROADCAST_BYTES = 4 << 20


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; null or without :// both are empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null. Rules are a short list: each is an expression."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def url_parts(host: Column, path: Column) -> Column:
    """Lower-case parts of the host (without its last label) and path: maximal runs of letters; digits don't count."""
    names = F.regexp_replace(host, r"(^|\.)[^.]*$", "")
    return F.filter(F.split(ascii_lower(F.concat_ws("/", names, path)), r"[^\p{L}]+"), lambda x: x != "")


def spans_of(parts: DataFrame, *columns: str) -> DataFrame:
    """columns, a, l, word: every substring of the parts from a on with l letters, 2 to LONGEST."""
    starts = F.explode(F.sequence(F.lit(1), F.length("part"))).alias("a")
    ahead = F.explode(F.sequence(F.lit(2), F.least(F.lit(LONGEST), F.length("rest")))).alias("l")
    spans = parts.select(*columns, "part", starts).select(*columns, "a", F.col("part").substr(F.col("a"), F.lit(LONGEST)).alias("rest")).where(F.length("rest") > 1)
    return spans.select(*columns, "a", "rest", ahead).select(*columns, "a", "l", F.substring("rest", F.lit(1), F.col("l")).alias("word"))


def word_costs(pages: DataFrame, html_column: str, known: Sequence[str], parts: DataFrame | None = None) -> DataFrame:
    """(word, n, known): how often words stand in the pages' texts; known ones are there even if they don't.

    Given the parts, words that no part holds are counted together, as the word "". A bitmap of the hashes of all their
    substrings, of a fixed size, finds most of these before anything is shuffled; words it takes for others are counted as
    themselves, which changes no cost."""
    text = F.regexp_replace(F.coalesce(F.col(html_column), F.lit("")), r"<[^>]*>", " ")
    words = pages.select(F.explode(F.regexp_extract_all(ascii_lower(text), F.lit(r"\p{L}{2,%d}" % LONGEST), 0)).alias("word"))
    if parts is not None:
        mark = F.pmod(F.xxhash64("word"), F.lit(BITMAP_BITS))
        bits = spans_of(parts).select(mark.alias("m")).groupBy(F.shiftright("m", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(m % 64 AS INT))")).alias("bits"))
        marked = words.withColumn("m", mark).withColumn("w", F.shiftright("m", 6)).join(F.broadcast(durable(bits)), "w", "left")
        there = F.coalesce(F.getbit("bits", (F.col("m") % 64).cast("int")) == 1, F.lit(False))
        words = marked.select(F.when(there, F.col("word")).otherwise("").alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    extra = pages.sparkSession.createDataFrame([(w, 0, True) for w in sorted(set(known))], "word string, n long, known boolean")
    return words.withColumn("known", F.lit(False)).unionByName(extra).groupBy("word").agg(F.sum("n").alias("n"), F.max("known").alias("known"))


def viterbi(part: str, costs: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The cheapest segmentation; costs: of known words, by (start, end). Unknown strings cost `unknown` and log 10 a letter."""
    n, infinite = len(part), math.inf
    best, back = [0.0] + [infinite] * n, [0] * (n + 1)
    ends: dict[int, list[tuple[int, float]]] = {}
    for (a, b), c in costs.items():
        ends.setdefault(b, []).append((a, c))
    step = math.log(10)
    # the cheapest start of an unknown string that goes on: best[a] - a * step
    start, start_cost = 0, 0.0
    for b in range(1, n + 1):
        best[b], back[b] = start_cost + unknown + b * step, start
        for a, c in ends.get(b, ()):
            if best[a] + c < best[b]:
                best[b], back[b] = best[a] + c, a
        if best[b] - b * step < start_cost:
            start, start_cost = b, best[b] - b * step
    out = []
    while n:
        out.append(part[back[n] : n])
        n = back[n]
    return out[::-1]


def segment(parts: DataFrame, costs: DataFrame) -> DataFrame:
    """(id, part, words) of distinct parts: every substring up to a length is joined to the words, so the words aren't broadcast."""
    total = costs.agg(F.sum("n")).first()[0] or 1
    cost = -F.log(F.col("n") / float(total) + F.when(F.col("known"), KNOWN_SHARE).otherwise(0.0))
    parts = durable(parts.withColumn("id", F.monotonically_increasing_id()))
    hits = F.collect_list(F.struct((F.col("a") - 1).alias("a"), (F.col("a") + F.col("l") - 1).alias("b"), cost.alias("c")))
    found = skew_join(spans_of(parts, "id"), costs, ["word"]).groupBy("id").agg(hits.alias("spans"))

    @F.pandas_udf("array<string>")
    def best(names: pd.Series, spans: pd.Series) -> pd.Series:
        unknown = -math.log(UNKNOWN_SHARE)
        return pd.Series([viterbi(x, {} if s is None else {(r["a"], r["b"]): r["c"] for r in s}, unknown) for x, s in zip(names, spans)], dtype=object)

    return skew_join(parts, found, ["id"], "left").select("id", "part", best("part", "spans").alias("words"))


def word_odds(tokens: DataFrame, shares: DataFrame) -> tuple[DataFrame, float]:
    """M step: (word, o) log-odds of each word, and of a page without words. tokens: bag, n, word, k; shares: bag, n, p."""
    blocked, pages = shares.agg(F.sum(F.col("n") * F.col("p")), F.sum("n")).first()
    by_word = skew_join(tokens, shares.select("bag", "p"), ["bag"]).groupBy("word").agg(F.sum(F.col("k") * F.col("n") * F.col("p")).alias("b"), F.sum(F.col("k") * F.col("n") * (1 - F.col("p"))).alias("a"))
    by_word = durable(by_word)
    size, b, a = (x or 0 for x in by_word.agg(F.count(F.lit(1)), F.sum("b"), F.sum("a")).first())
    share = lambda column, total: F.log((F.col(column) + SMOOTHING) / (total + SMOOTHING * (size + 1)))
    return by_word.select("word", (share("b", b) - share("a", a)).alias("o")), math.log(((blocked or 0) + 1) / ((pages or 0) - (blocked or 0) + 1))


def bag_odds(tokens: DataFrame, odds: DataFrame, prior: float) -> DataFrame:
    """E step: (bag, n, log_odds, p)."""
    size = odds.agg(F.sum(F.octet_length("word") + 16)).first()[0] or 0
    joined = tokens.join(F.broadcast(odds), "word") if size <= BROADCAST_BYTES else skew_join(tokens, odds, ["word"])
    scores = joined.groupBy("bag", "n").agg(F.round(F.sum(F.col("k") * F.col("o")) + prior, 9).alias("log_odds"))
    return scores.withColumn("p", 1 / (1 + F.exp(-F.col("log_odds"))))


def learn(tokens: DataFrame, seeds: Sequence[str] = SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """(bag, n, log_odds, p) of all bags by the last model. tokens: bag, its pages n, word, and how often (k) the bag has it."""
    seeded = F.max(F.col("word").isin(*seeds).cast("double"))
    shares = marks = durable(tokens.groupBy("bag", "n").agg(seeded.alias("p")))
    for k in range(rounds + 1):
        if k:
            shares = skew_join(scores.select("bag", "n", F.col("p").alias("q")), marks.select("bag", "p"), ["bag"]).withColumn("p", F.greatest("p", "q"))
        scores = durable(bag_odds(tokens, *word_odds(tokens, durable(shares))))
    return scores


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, seeds: Sequence[str] = SEEDS, known: Sequence[str] = (*SEEDS, *COMMON), rounds: int = ROUNDS, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, log_odds (of blocking, by the method; null if no words).

    Null urls and those without :// have empty host and path, and without a rule are allowed, as is every url without
    words. Repeated rows and ties are judged alike; null html has no words. Columns of other names aren't read; an empty
    table gives an empty result. Urls of any length are segmented whole.
    """
    host, path = split_url(F.col(url_column))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("bag", F.array_join(url_parts(F.col("host"), F.col("path")), " "))
    bags = rows.groupBy("bag").agg(F.count(F.lit(1)).alias("n")).where("bag <> ''").withColumnRenamed("bag", "text")
    bags = durable(bags.withColumn("bag", F.monotonically_increasing_id()))
    split_bags = bags.select("bag", "n", F.explode(F.split("text", " ")).alias("part"))
    parts = durable(split_bags.select("part").distinct())
    words = durable(segment(parts, durable(word_costs(pages, html_column, [*known, *seeds], parts))))
    tokens = skew_join(split_bags, words, ["part"]).select("bag", "n", F.explode("words").alias("word")).groupBy("bag", "n", "word").agg(F.count(F.lit(1)).alias("k"))
    scores = skew_join(bags.select("bag", "text"), learn(durable(tokens), seeds, rounds).select("bag", "log_odds"), ["bag"]).select(F.col("text").alias("bag"), "log_odds")
    out = skew_join(rows.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)), scores, ["bag"], "left")
    verdict = F.coalesce("best.action", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "log_odds")
