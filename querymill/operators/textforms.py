"""Small forms on words, literals and conditions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.dialect.catalog import Catalog
from querymill.functions.text import let


def projection_role(table: Column, select: Column, conds: Column, catalog: Catalog) -> Column:
    """What a projection shows: *, a condition's column, the identifying column, the own id, or an attribute."""
    of = lambda f: F.coalesce(*[F.when(table == t.name, F.lit(getattr(t, f))) for t in catalog.tables.values()])
    cols = F.transform(F.coalesce(conds, F.array()), lambda c: c["col"])
    return F.when(select == "*", "*").when(F.array_contains(cols, select), "cond_col").when(select == of("ident"), "ident").when(select == of("own_id"), "own_id").otherwise("attr")


def like_mode(pattern: Column) -> Column:
    """prefix, suffix, contains or exact."""
    head, tail = pattern.startswith("%"), pattern.endswith("%")
    return F.when(head & tail, "contains").when(head, "suffix").when(tail, "prefix").otherwise("exact")


def fragment(pattern: Column) -> Column:
    return F.trim(pattern, F.lit("%"))


def cut(word: Column, mode: Column, n: int) -> Column:
    """A fragment of n letters of a word by mode: its beginning, its end, or from its second letter."""
    return F.when(mode == "prefix", F.substring(word, 1, n)).when(mode == "suffix", F.right(word, F.lit(n))).otherwise(F.substring(word, 2, n))


def literal(value: Column, kind: Column) -> Column:
    """Text quoted, floats with two decimals, others as they are."""
    return F.when(kind.isin("name", "cat", "date"), F.concat(F.lit("'"), value, F.lit("'"))).when(kind == "float", F.format_string("%.2f", value.try_cast("double"))).otherwise(value)


def six_digits(x: Column) -> Column:
    """A number with at most six significant digits and no trailing zeros; with an exponent from a million on and below 0.0001."""
    digits = F.greatest(5 - F.floor(F.log10(F.abs(x))), F.lit(0)).cast("int")
    text = F.format_string("%.6f", F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)))
    plain = F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    # the exponent form: mantissa of five decimals without trailing zeros, sign and two digits or more
    written = F.format_string("%.5e", x.cast("double"))
    mantissa = F.rtrim(F.rtrim(F.split_part(written, F.lit("e"), F.lit(1)), F.lit("0")), F.lit("."))
    exponent = F.split_part(written, F.lit("e"), F.lit(2))
    far = (x != 0) & ((exponent.cast("int") >= 6) | (exponent.cast("int") < -4))
    return F.when(x.isNull(), None).when(far, F.concat(mantissa, F.lit("e"), exponent)).otherwise(plain)


def masked(text: Column) -> Column:
    """Struct of the text with each quoted literal or number as a {n} slot, and the literals in order."""
    pattern = r"('[^']*'|(?<![A-Za-z0-9_])\d+(?:\.\d+)?)"

    def build(found: Column) -> Column:
        parts = F.split(F.regexp_replace(text, pattern, "\x01"), "\x01")
        filled = F.array_join(F.transform(parts, lambda p, i: F.when(i + 1 < F.size(parts), F.concat(p, F.lit("{"), i.cast("string"), F.lit("}"))).otherwise(p)), "")
        return F.struct(filled.alias("mask"), found.alias("literals"))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), build)


def unmasked(mask: Column, literals: Column) -> Column:
    """The text of a mask and its literals."""
    step = lambda acc, x: F.struct(F.replace(acc["t"], F.concat(F.lit("{"), acc["i"].cast("string"), F.lit("}")), x).alias("t"), (acc["i"] + 1).alias("i"))
    return F.aggregate(literals, F.struct(mask.alias("t"), F.lit(0).alias("i")), step)["t"]


def in_text_order(values: Column, text: Column) -> Column:
    """Values by their first place in a text; those it lacks come last, then by value."""
    place = lambda v: F.when(F.instr(F.lower(text), F.lower(v)) > 0, F.instr(F.lower(text), F.lower(v))).otherwise(1_000_000)
    return F.transform(F.array_sort(F.transform(values, lambda v: F.struct(place(v).alias("p"), v.alias("v")))), lambda s: s["v"])


def plural(word: Column) -> Column:
    """Regular plural."""
    return (
        F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).when(word.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(word, "y$", ""), F.lit("ies"))).otherwise(F.concat(word, F.lit("s")))
    )


def bases(word: Column) -> Column:
    """Possible base forms by ending: the word itself first."""
    forms = [word]
    for ending, new in (("ies$", "y"), ("es$", ""), ("s$", ""), ("ing$", ""), ("ing$", "e"), ("ed$", ""), ("ed$", "e"), ("er$", ""), ("est$", "")):
        forms.append(F.when(word.rlike("..." + ending), F.regexp_replace(word, ending, new)))
    return F.array_distinct(F.array_compact(F.array(*forms)))


def occurrences(text: Column, value: Column) -> Column:
    """How often a value stands alone in a text."""
    quoted = F.regexp_replace(F.lower(value), r"([^\p{L}\p{N} ])", r"\\$1")
    return F.regexp_count(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])")))


def comparisons(text: Column) -> Column:
    """Comparisons that a wording makes, as 'op value': ranges, bounds and negations of bounds."""
    t = F.lower(text)
    number = r"\$?(\d+(?:\.\d+)?)"
    cues = (
        (r"(?:no less than|not less than|at least|minimum|min|no fewer than|no lower than|starting at)\s+" + number, ">="), (r"(?:no more than|not more than|at most|up to|maximum|max)\s+" + number, "<="),
        (r"(?<!no )(?<!not )(?:more than|above|over|greater than|higher than|exceeding)\s+" + number, ">"), (r"(?<!no )(?<!not )(?:less than|below|under|fewer than|lower than|cheaper than)\s+" + number, "<"),
    )

    def found(pattern: str, op: str) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda v: F.concat(F.lit(op + " "), v.cast("double").cast("string")))

    return F.concat(*[found(p, op) for p, op in cues])


def extra_values(text: Column, sql: Column, known: list[str]) -> Column:
    """Known category values that a text names and its statement does not use."""
    named = F.filter(F.array(*[F.lit(k) for k in known]), lambda k: F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), k, F.lit(r"(?![\p{L}\p{N}])"))))
    return F.filter(named, lambda k: ~F.contains(F.lower(sql), k))


def hex_ids(text: Column) -> Column:
    """Bytes of a text in hexadecimal, the form of token fixtures."""
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def from_hex(code: Column) -> Column:
    """Text of hexadecimal bytes; null when they are not UTF-8."""
    return F.try_validate_utf8(F.unhex(code).cast("string"))


def stem_in(words, known):
    """Words with a base form among the known ones: (word). words, known: tables with a column word."""
    return words.select("word", F.explode(bases(F.col("word"))).alias("base")).join(known.select(F.col("word").alias("base")).distinct(), "base", "left_semi").select("word").distinct()
