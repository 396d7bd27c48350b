"""Quality rules as a bitmask ledger. DataFrame operations only.

Every rule is evaluated once per document; its failure is a bit of `failures`, its measurement a column. Policies are
versioned bitmasks over that ledger, so a change of policy reads no text, and ablations are bitwise aggregations.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Rule -> failure condition over the measurements, in SQL. The order gives the bits; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
}

#: Policy version -> rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_words", "long_words", "symbols", "repeated_lines"),
}


def mask_of(policy: tuple[str, ...], rules: Mapping[str, str] = RULES) -> int:
    names = list(rules)
    return sum(1 << names.index(x) for x in policy)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once even where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows that occur twice or more in the array, first occurrences included.

    Windows are compared by 64-bit hashes within their text. Texts without a repeated window stop at a distinct
    count; the others sort (hash, position), so time is n log n whatever repeats.
    """

    def digests(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(w[i + k] for k in range(window))))

    def covered(marks: Column) -> Column:
        # a window covers its words up to where the next marked one starts
        gaps = F.transform(marks, lambda p, i: F.when(i + 1 < F.size(marks), F.least(F.lit(window), F.get(marks, i + 1) - p)).otherwise(F.lit(window)))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def marked(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        same = lambda s, i, j: F.get(s, j)["h"] == F.get(s, i)["h"]
        twice = lambda s: F.filter(s, lambda x, i: F.coalesce(same(s, i, i - 1), F.lit(False)) | F.coalesce(same(s, i, i + 1), F.lit(False)))
        return F.array_sort(F.transform(_let(pairs, twice), lambda x: x["p"]))

    return F.when(F.size(words) <= window, 0).otherwise(
        _let(words, lambda w: _let(digests(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(marked(h), covered))))
    )


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the measurements n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all bigint)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    base = docs.select(
        F.col(id_column).alias("doc_id"),
        words_of(F.col(text_column)).alias("words"),
        lines.alias("lines"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    return base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, rules: Mapping[str, str] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The measurements and `failures`, a bit for each failed rule.

    Null, empty and blank texts have no words: every count is 0 and few_words fails. Rows aren't compared, so repeated
    rows, ties and null ids stay as they are; other columns, whatever their names, are not read; an empty table gives an
    empty ledger.
    """
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules.values())]
    failures = F.lit(0).cast("long")
    for bit in bits:
        failures = failures.bitwiseOR(bit)
    return measure(docs, id_column, text_column).withColumn("failures", failures)


def apply_policy(book: DataFrame, policy: str, rules: Mapping[str, str] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> Column:
    """True where the policy keeps the document; reads only the ledger."""
    return book["failures"].bitwiseAND(F.lit(mask_of(policies[policy], rules))) == 0


def ablations(book: DataFrame, policy: str, rules: Mapping[str, str] = RULES, policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each rule of a policy: documents it fails, and those it alone rejects (kept if the rule were dropped)."""
    mask, names = mask_of(policies[policy], rules), list(rules)
    hit = F.col("failures").bitwiseAND(F.lit(mask))
    patterns = book.groupBy(hit.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("rule"), F.lit(1 << names.index(x)).cast("long").alias("bit")) for x in policies[policy])))
    rows = patterns.select("bits", "n", each.alias("r")).where(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))


#: The ledger's result by DuckDB.
ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
spread AS (SELECT r, unnest(range(1, len(words) - 3)) AS p, words FROM w WHERE len(words) >= 5),
windows AS (SELECT r, p, array_to_string(words[p:p + 4], ' ') AS s FROM spread),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 5)) AS q FROM twice) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
  CAST(CAST(n_words < 10 AS INT) + 2 * CAST(100 * n_repeat_words > 20 * n_words AS INT) + 4 * CAST(word_chars < 2 * n_words AS INT)
    + 8 * CAST(word_chars > 20 * n_words AS INT) + 16 * CAST(10 * n_symbols > n_words AS INT) + 32 * CAST(10 * n_dup_lines > 3 * n_lines AS INT) AS BIGINT) AS failures,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM m
"""
