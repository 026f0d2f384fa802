"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE_RUN = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"
#: Everything but ASCII digits, a-z and characters beyond ASCII (after A-Z became a-z).
NOT_ITEM_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value evaluated once for each row, however often the body names it.

    A lambda variable can't be inlined by the optimizer, so arrays used inside other lambdas are
    built once and not once for every element.
    """
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def split_words(text: Column, separators: str = SPACE_RUN) -> Column:
    """Words of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else, so that no locale or Unicode version matters."""
    plain = F.octet_length(text) == F.length(text)  # lower() is faster and the same where all is ASCII
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hash of each run of k neighbours of an array of longs; empty if there are fewer than k."""
    return let(
        hashes,
        lambda h: F.when(
            F.size(h) >= k,
            F.transform(
                F.slice(h, 1, F.size(h) - (k - 1)),
                lambda first, i: F.xxhash64(first, *[F.get(h, i + j) for j in range(1, k)]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
