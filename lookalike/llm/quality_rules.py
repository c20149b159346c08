"""Quality rules as a ledger: measure once, decide as often as wanted.

``ledger`` evaluates every rule once for each document and stores what it
measured and a bit per failed rule. A policy is a version and a mask of the
rules it heeds; applying one, or asking what a rule does to a policy, only
reads the bits. All of it is column expressions: nothing is shuffled, and no
Python runs on the executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind, positions
from .common import WORD, whole

WINDOW = 8
SYMBOLS = "#*$%&|<>"  # fixed by the contract
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")


class Rule(NamedTuple):
    """A document fails where ``fails`` (SQL over the measurements) is true."""

    name: str
    fails: str


#: Bit k of a ledger belongs to rule k. New rules go to the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule("symbols", "100 * n_symbols > 30 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", "100 * n_upper > 60 * n_letters"),
)


class Policy(NamedTuple):
    version: str
    rules: tuple[str, ...]

    def mask(self) -> int:
        return sum(1 << k for k, rule in enumerate(RULES) if rule.name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(r.name for r in RULES))


def _repeat_words(words: Column) -> Column:
    """Words inside windows whose like occurs again; windows are compared by
    64-bit hashes, so a text with a million words errs with odds of one to
    thirty million. ``words`` is an array of hashes of words."""
    windows = bind(
        words,
        lambda w: F.transform(
            positions(F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i + 1, WINDOW))
        ),
    )

    def covered(keys):
        pairs = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        again = bind(
            pairs,
            lambda s: F.filter(
                s,
                lambda x, j: F.coalesce(
                    (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"]),
                    F.get(s, j - 1)["k"] == x["k"],
                    F.get(s, j + 1)["k"] == x["k"],
                    F.lit(False),
                ),
            ),
        )
        starts = F.array_sort(F.transform(again, lambda x: x["i"]))
        # a window adds what reaches beyond the one before it
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda acc, i: F.struct(
                (acc["n"] + WINDOW - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")
            ),
            lambda acc: acc["n"],
        )

    return bind(windows, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), 0).otherwise(covered(k)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``MEASURES`` as longs, a row per row of ``docs``.

    A null text has no words and no lines. Other columns are not read. An
    empty table gives an empty one.
    """
    text = F.col("t")
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    parted = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("t")).select(
        "doc_id", "t", bind(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("x"),
    )

    def left(but: str) -> Column:
        return F.length(F.regexp_replace(text, but, ""))

    found = {
        "n_words": F.col("w.n"),
        "word_chars": left(r"[\x20\x09-\x0D]+"),
        "n_symbols": left(f"[^{SYMBOLS}]+"),
        "n_lines": F.col("x.n"),
        "n_dup_lines": F.col("x.n") - F.col("x.d"),
        "n_repeat_words": F.col("w.r"),
        "n_upper": left(r"[^\p{Lu}]+"),
        "n_letters": left(r"[^\p{L}]+"),
    }
    return parted.select("doc_id", *[found[m].cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failed``, a long with a bit per failed rule."""
    bits = [F.when(F.expr(rule.fails), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES)]
    return measured(docs, id_col, text_col).withColumn("failed", sum(bits[1:], bits[0]).cast("long"))


def fails(policy: Policy) -> Column:
    """Whether a row of a ledger fails ``policy``."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask())) != 0


def ablation(entries: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """For each rule of ``policy``: documents that fail it (n_failed), that
    fail nothing else (n_only), and that the policy keeps without it (n_kept).

    Rows of equal bits are counted first, so at most a row per set of rules
    goes on. An empty ledger gives no row.
    """
    mask = policy.mask()
    sets = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).count()
    rules = F.explode(
        F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if mask >> k & 1])
    )
    bit, bits = F.col("r.bit"), F.col("bits")

    def docs(where):
        return F.sum(F.when(where, F.col("count")).otherwise(0))

    return (
        sets.select("bits", "count", rules.alias("r"))
        .groupBy("r.rule")
        .agg(
            docs(bits.bitwiseAND(bit) != 0).alias("n_failed"),
            docs(bits == bit).alias("n_only"),
            docs(bits.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept"),
        )
        .withColumn("version", F.lit(policy.version))
    )


def keep(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The documents that pass ``policy``, in one pass without a join: the
    ledger is taken of the rows themselves."""
    row = F.struct(*docs.columns)
    entries = ledger(docs.select(row.alias("row"), F.col("text").alias("body")), "row", "body")
    return entries.where(~fails(policy)).select("doc_id.*")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's measurements, base_failed and kept."""
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return ledger(docs).select(
        "doc_id", *shown, "failed", fails(BASE).alias("base_failed"), (~fails(BASE) & ~fails(STRICT)).alias("kept")
    )


def oracle() -> str:
    """SQL for ``report``, with the windows as rows."""
    failed = " + ".join(f"(CASE WHEN {r.fails} THEN {1 << k} ELSE 0 END)" for k, r in enumerate(RULES))
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), {word}) AS w FROM documents),
windows AS (
  SELECT id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
  FROM texts, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)),
again AS (SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
repeats AS (
  SELECT id, count(DISTINCT i + k) AS n FROM again, range({WINDOW}) AS r(k) GROUP BY id),
measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word}))) AS n_lines,
    n_lines - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
    length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters
  FROM texts LEFT JOIN repeats USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS failed,
  failed & {BASE.mask()} <> 0 AS base_failed, failed & {BASE.mask() | STRICT.mask()} = 0 AS kept
FROM measured"""
