"""Text canonicalisation as JVM-side column expressions.

A *word* is an unbroken run of letters or digits after compatibility composition (NFKC) and case folding.
Null text gives an empty array of words. No expression here starts a Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Separators of labelled fields, the strongest first. A line break ends a field only where a new label follows.
FIELD_SEPARATORS = (r"\|", ";", r"[\n\r\x{85}\x{2028}\x{2029}]+(?=[^:=\n\r]*[:=])", r"[|;\n\r]+")
LABELLED = r"^[^:=]*[\p{L}\p{N}][^:=]*[:=]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def fold(text: Column) -> Column:
    """NFKC and case folding; plain ASCII text skips the Unicode path."""
    text = F.coalesce(text, F.lit(""))
    wide = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(F.replace(F.lower(wide), F.lit("ß"), F.lit("ss")), "ς", "σ")).otherwise(F.lower(text))


def words_of_folded(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order; empty array for null text or text without words."""
    return words_of_folded(fold(text))


def labelled_fields(folded: Column) -> Column:
    """Fields of a question written as ``label: value`` or ``label = value``, else null.

    The first separator by which every part has a label, and there are two parts or more, is taken.
    """
    tries = []
    for sep in FIELD_SEPARATORS:
        parts = F.filter(F.split(folded, sep), lambda p: p.rlike(r"[\p{L}\p{N}]"))
        tries.append(let(parts, lambda p: F.when((F.size(p) >= 2) & F.forall(p, lambda x: x.rlike(LABELLED)), p)))
    return F.when(folded.rlike(r"[:=]") & folded.rlike(r"[|;\n\r\x{85}\x{2028}\x{2029}]"), F.coalesce(*tries))


def field_signature(folded: Column) -> Column:
    """The fields, each as its words, sorted; null for text that is not written as fields."""
    join = lambda p: F.array_join(words_of_folded(p), " ")
    return F.array_join(F.sort_array(F.transform(labelled_fields(folded), join)), "\x01")


def hash_pair(value: Column) -> list[Column]:
    """128 bits as two LONG columns from differently seeded hashes; null stays null."""
    return [F.when(value.isNotNull(), F.xxhash64(value)), F.when(value.isNotNull(), F.xxhash64(F.lit("querymill"), value))]


def bag_elements(ws: Column) -> Column:
    """Words as LONG hashes, each numbered by its occurrence: the set of the results stands for the bag of words."""
    hashes = F.sort_array(F.transform(ws, lambda w: F.xxhash64(w)))

    def number(s: Column) -> Column:
        return F.transform(
            s,
            lambda h, i: F.when((i > 0) & (s[F.greatest(i - 1, F.lit(0))] == h), F.xxhash64(h, i - F.array_position(s, h))).otherwise(h),
        )

    return let(hashes, number)
