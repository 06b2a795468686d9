"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
per rule; a policy is a versioned bit mask over it, so changing a policy or asking what a single
rule costs never touches a text again.

Defined cases: a NULL text has no words (every measurement 0, so it fails ``few_words``); an empty
text likewise. NULL ids and repeated rows each give a ledger row of their own. Extra columns stay;
an input column that has the name of a ledger column is replaced by it. An empty table gives an
empty ledger. A text is measured whole, at any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names

WINDOW = 8

#: Rule names by bit, lowest first. New rules go to the end: stored ledgers keep their meaning.
RULES = ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "shouting", "one_word")

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct_words")


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES.index(r) for r in self.rules)


POLICIES = {
    "base": Policy("base", ("few_words", "repeated_windows")),
    "v1": Policy("v1", RULES),
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    """The words of a text whose separators are all blanks."""
    parts = F.split(text, " ")
    return F.when(F.contains(text, F.lit("  ")) | (text == ""), F.filter(parts, lambda w: w != "")).otherwise(parts)


def _paired(hashes: Column, step: int) -> Column:
    """The hash of elements i and i + step, for every i that has both."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, step + 1, n), lambda a, b: F.xxhash64(a, b))


def _covered(starts: Column) -> Column:
    """Words under windows at these ascending starts; each window counts up to the next start."""
    n = F.greatest(F.size(starts) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(starts, 1, n), F.slice(starts, 2, n), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(gaps, F.lit(WINDOW).cast("long"), lambda s, g: s + g)


def _repeat_words(windows: Column) -> Column:
    """Number of words that stand in a window whose hash occurs at least twice."""

    def of_sorted(s: Column) -> Column:
        last = F.size(s) - 1
        hit = F.filter(
            s,
            lambda x, i: ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])) | ((i < last) & (F.get(s, F.least(i + 1, last))["h"] == x["h"])),
        )
        return _let(F.array_sort(F.transform(hit, lambda x: x["i"])), _covered)

    keyed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(F.array_sort(keyed), of_sorted))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of every text.

    n_words, word_chars (code points in words), n_symbols (characters of ``#*$%&|<>``), n_dup_lines
    (lines with a word that equal an earlier line), n_repeat_words (words in repeated 8-word windows,
    compared by 64-bit hashes), n_lines (lines with a word), n_upper (A-Z), n_distinct_words (by hash).
    """
    t = F.coalesce(F.col(text), F.lit(""))
    blank = t
    for c in "\n\t\r\x0b\f":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    flat, rows, *hashes = free_names(docs, "_blank", "_lines", "_h1", "_h2", "_h4", "_h8")
    out = docs.withColumns({flat: F.trim(blank), rows: lines})
    out = out.withColumn(hashes[0], F.transform(_words(F.col(flat)), lambda w: F.xxhash64(w)))
    for k in range(3):  # windows of 2, 4 and then 8 words
        out = out.withColumn(hashes[k + 1], _paired(F.col(hashes[k]), 1 << k))
    long = lambda c: c.cast("long")
    without = lambda pattern: F.length(t) - F.length(F.regexp_replace(t, pattern, ""))
    out = out.withColumns(
        {
            "n_words": long(F.size(hashes[0])),
            "word_chars": long(F.length(F.replace(F.col(flat), F.lit(" "), F.lit("")))),
            "n_symbols": long(without("[#*$%&|<>]+")),
            "n_lines": long(F.size(rows)),
            "n_dup_lines": long(F.size(rows) - F.size(F.array_distinct(rows))),
            "n_repeat_words": _repeat_words(F.col(hashes[3])),
            "n_upper": long(without("[A-Z]+")),
            "n_distinct_words": long(F.size(F.array_distinct(hashes[0]))),
        }
    )
    return out.drop(flat, rows, *hashes)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit k is set where the document fails RULES[k].

    few_words: under 20 words. repeated_windows: over 30% of the words stand in repeated windows.
    symbols: over three symbols for every ten words. repeated_lines: over half of the lines repeat
    earlier ones (a passage that many documents share is not enough). word_length: mean word under 1.5 or over 40 code points. shouting: of 50 code points in words or more,
    over half are A-Z. one_word: of 20 words or more, under 5% are distinct and fewer than 20.
    """
    c = F.col
    failed = {
        "few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbols": 10 * c("n_symbols") > 3 * c("n_words"),
        "repeated_lines": 2 * c("n_dup_lines") > c("n_lines"),
        "word_length": (2 * c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 40 * c("n_words")),
        "shouting": (c("word_chars") >= 50) & (2 * c("n_upper") > c("word_chars")),
        "one_word": (c("n_words") >= 20) & (c("n_distinct_words") < 20) & (100 * c("n_distinct_words") < 5 * c("n_words")),
    }
    bits = F.lit(0).cast("long")
    for k, name in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(failed[name], F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text).withColumn("fail_bits", bits)


def passes(policy: Policy) -> Column:
    """Whether a ledger row passes under a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(led: DataFrame, policy: Policy) -> DataFrame:
    """Add ``policy_version`` and ``kept`` to a ledger."""
    return led.withColumns({"policy_version": F.lit(policy.version), "kept": passes(policy)})


def ablation(led: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy costs: rule, n_failed, n_only (rejected by it alone), n_kept_without.

    The ledger is first counted by its masked bits (at most 2^rules rows, combined map-side).
    """
    by_bits = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in policy.rules])
    each = by_bits.select("b", "n", F.explode(rules).alias("r")).select("b", "n", "r.rule", "r.bit")
    hit, alone = F.col("b").bitwiseAND(F.col("bit")) != 0, F.col("b") == F.col("bit")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        total(hit).alias("n_failed"),
        total(alone).alias("n_only"),
        total((F.col("b") == 0) | alone).alias("n_kept_without"),
    )


def keep_passing(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The documents that pass a policy, with the columns they came with.

    A row of the ledger is kept by a generator of one element or none. A plain filter would be pushed
    below the measurements, and they would be computed again at each of their mentions.
    """
    led = ledger(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_t")), "_t")  # whatever the columns' names
    one = F.when(passes(policy), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return led.withColumn("_kept", F.explode(one)).select("_row.*")
