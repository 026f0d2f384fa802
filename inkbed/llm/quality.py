"""Quality rules as a bitmask ledger (native).

Every rule is evaluated once for each document.  The ledger keeps one bit for each failed rule next to the
measurements, so that policies (versioned sets of bits) and ablations are bitwise work on the ledger and
never touch the texts again.

Defined cases: a null or empty text has no words and fails ``few_words``; nulls in other columns don't
matter; a very long text is an array of words in one row; repeated rows give repeated rows, with the same bits; extra columns
are not carried, so their names don't matter; an empty table gives an empty ledger, and an ablation of zeros.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import gram_hashes, let, split_words

WINDOW = 5
NOT_SYMBOLS = "[^#*$%&|<>]+"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``failed`` (over the measurements) is true; ``bit`` never changes once published."""

    name: str
    bit: int
    failed: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "10 * n_dup_lines > 6 * n_lines"),
    Rule("long_words", 4, "word_chars > 15 * n_words"),
    Rule("short_words", 5, "2 * word_chars < 3 * n_words"),
    Rule("capitals", 6, "2 * n_upper > word_chars"),
    Rule("echoes", 7, "3 * n_echoes > n_words"),
)
#: Rules of each policy version.
POLICIES: Mapping[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "long_words", "short_words", "capitals", "echoes"),
}


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in names)


def _repeat_words(words: Column, k: int) -> Column:
    """Words that lie in a k-word window found twice or more in the same text.

    Almost all texts have no repeated window, which the size of the distinct windows tells; only the others
    are sorted, to find the repeated windows' places and the union of their spans.
    """

    def covered(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            pairs,
            lambda p: F.sort_array(
                F.transform(
                    F.filter(p, lambda x, i: (F.get(p, i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(p, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))),
                    lambda x: x["i"],
                )
            ),
        )
        return let(
            places,
            lambda at: F.aggregate(
                F.transform(at, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - x, F.lit(k)))),
                F.lit(0).cast("bigint"),
                lambda total, x: total + x,
            ),
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        gram_hashes(hashes, k),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(covered(g)),
    )


def measure(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: the measurements that rules are written in (all bigint)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text"), split_words(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    measures = let(
        F.struct(F.col("words").alias("w"), lines.alias("l")),
        lambda v: F.struct(
            F.size(v["w"]).cast("bigint").alias("n_words"),
            F.length(F.array_join(v["w"], "")).cast("bigint").alias("word_chars"),
            F.size(v["l"]).cast("bigint").alias("n_lines"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(v["w"], lambda x, i: x == F.get(v["w"], i - 1))).cast("bigint").alias("n_echoes"),
            _repeat_words(v["w"], window).alias("n_repeat_words"),
        ),
    )
    return split.select(
        "doc_id",
        F.length(F.regexp_replace("text", NOT_SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("bigint").alias("n_upper"),
        measures.alias("m"),
    ).select("doc_id", "m.*", "n_symbols", "n_upper")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and ``rule_mask``, a bigint with the bit of each failed rule set."""
    mask = F.lit(0).cast("bigint")
    for r in rules:
        mask = mask.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs).withColumn("rule_mask", mask)


def apply_policy(rows: DataFrame, policy: str = "v1", policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """``base_failed`` and ``kept`` from the ledger's bits alone."""
    hit = lambda names: F.col("rule_mask").bitwiseAND(F.lit(mask_of(names))) != 0
    return rows.withColumn("base_failed", hit(policies["base"])).withColumn("kept", ~hit(tuple(dict.fromkeys(policies["base"] + policies[policy]))))


def ablation(rows: DataFrame, policy: str = "v1", policies: Mapping[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail only it, and that the policy keeps without it."""
    names = tuple(dict.fromkeys(policies["base"] + policies[policy]))
    full = mask_of(names)
    hit = F.col("rule_mask").bitwiseAND(F.lit(full))
    parts = []
    for n in names:
        bit = mask_of((n,))
        parts.append(
            F.struct(
                F.lit(n).alias("rule"),
                F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias("n_failed"),
                F.count_if(hit == bit).alias("n_only"),
                F.count_if(hit.bitwiseAND(F.lit(full & ~bit)) == 0).alias("n_kept_without"),
            )
        )
    return rows.agg(F.array(*parts).alias("a")).select(F.inline("a"))
