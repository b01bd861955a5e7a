"""Rewriting of question texts: protected spans, word maps, phrase rules, name swaps, clean-up, span merging."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrase rules (pattern, replacement), applied in this order; comparators like max and min are left out on purpose.
MEASURE = r"((?:ordered\s+)?(?:quantity|stock(?:\s+(?:level|units?))?|price))"
PHRASES = (
    (r"\brecord\s+counts?\b", "row count"),
    (r"\bnumber\s+of\s+records\b", "number of rows"),
    (r"\barithmetic\s+mean\s+of\b", "average"),
    (r"\bmean\s+value\s+of\b", "average"),
    (r"\bavg\.?\s+of\b", "average"),
    (r"\bavg\b", "average"),
    (r"\bqty\b", "quantity"),
    (r"\basc\b", "ascending"),
    (r"\bdesc\b", "descending"),
    (rf"\bcombined\s+{MEASURE}\b", "total $1"),
    (rf"\blargest\s+{MEASURE}\b", "highest $1"),
    (rf"\bsmallest\s+{MEASURE}\b", "lowest $1"),
)
# Comparison signs, read only where no other sign touches them.
SYMBOLS = ((">=", "at least"), ("<=", "at most"), ("!=", "not equal to"), (">", "more than"), ("<", "less than"), ("=", "equal to"))


def phrase_rules(text: Column, rules: Sequence[tuple[str, str]] = PHRASES) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, f"(?i){pattern}", new)
    return text


def symbol_rules(text: Column) -> Column:
    for sign, new in SYMBOLS:
        text = F.regexp_replace(text, rf"\s*(?<![<>=!]){re.escape(sign)}(?![<>=!])\s*", f" {new} ")
    return text


def replace_word(text: Column, old: Column, new: Column) -> Column:
    """Whole-word replacement that keeps a plural or possessive ending."""
    quoted = F.regexp_replace(old, r"([^\p{L}\p{N} ])", r"\\$1")
    return F.regexp_replace(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?=(?:'s|s|es)?(?![\p{L}\p{N}_]))")), new)


def finish(text: Column) -> Column:
    """Blanks before marks off, runs of blanks to one, a before a vowel to an, lower case."""
    t = F.regexp_replace(F.lower(text), r"\s+([,.?!;:])", "$1")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    t = F.regexp_replace(t, r"\ba (?=[aeiou])", "an ")
    return F.regexp_replace(t, r"\b1 (unit|item|piece|order|row)s\b", "1 $1")


# Styles with their shares, and the openings that tell them.
STYLE_SHARES = {"common": 0.70, "conversational": 0.20, "contextual": 0.10}
CONTEXTUAL = r"^(?:for (?:an?|my|our) |i(?: am|'m) (?:working|reviewing|preparing|checking)|we (?:are|need)|as part of)"
CONVERSATIONAL = r"^(?:(?:can|could|would|will) you\b|(?:hey|hi|any chance|i'd like|i would like|let's|let me)\b)"


def style_of(text: Column) -> Column:
    """Style by the opening words."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike(CONTEXTUAL), "contextual").when(t.rlike(CONVERSATIONAL), "conversational").otherwise("common")


def styled_picks(entries: DataFrame, role: str, key: str, style: str, shares: Mapping[str, float] = STYLE_SHARES, seed: int = 42) -> DataFrame:
    """(role, key, style): one entry for each role. A style is drawn first, by the shares of the styles the role has, scaled
    to 1, then an entry of that style by seeded hash. Styles without share are never drawn; roles and styles must not be null."""
    weight = F.coalesce(*[F.when(F.col(style) == s, F.lit(w)) for s, w in shares.items()], F.lit(0.0))
    best = entries.where(F.col(role).isNotNull() & F.col(style).isNotNull()).groupBy(role, style).agg(
        F.min(F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("h"), F.col(key).alias("k"))).alias("m")
    )
    rows = best.withColumn("w", weight).where("w > 0").groupBy(role).agg(F.array_sort(F.collect_list(F.struct(F.col(style).alias("s"), "w", F.col("m.k").alias("k")))).alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x["w"])
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:style"), F.col(role).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    at = lambda i: F.aggregate(F.slice("a", F.lit(1), i + 1), F.lit(0.0), lambda acc, x: acc + x["w"])
    chosen = F.filter("a", lambda x, i: at(i) > u * total)[0]
    return rows.select(role, chosen["k"].alias(key), chosen["s"].alias(style))


def merged_spans(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Overlapping or touching spans of a key as one: gaps and islands over running maxima."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(key, start, end, F.when(reach >= F.col(start), 0).otherwise(1).alias("new"))
    island = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "island").agg(F.min(start).alias("span_start"), F.max(end).alias("span_end")).drop("island")


def first_spans(spans: Column) -> Column:
    """Non-overlapping spans of an array of structs (s, e): by start, the longest first, each begins at or after the last end."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(b["e"] - a["e"]).cast("int"))
    keep = lambda acc, x: F.when((F.size(acc) == 0) | (F.element_at(acc, -1)["e"] <= x["s"]), F.concat(acc, F.array(x))).otherwise(acc)
    return F.aggregate(ordered, F.slice(ordered, 1, 0), keep)


# What is never rewritten; a group named value is protected alone.
LETTERS = r"(?:(?:the\s+)?(?:letters?|characters?|text|string|substring|fragment)\s+)?"
PROTECT = tuple(re.compile(p, re.I) for p in (
    r"'[^']*'|\"[^\"]*\"",
    r"\d[\d.,:-]*",
    rf"\b(?:start|begin|end|finish)(?:s|es|ing|ning)?\s+(?:(?:with|in)\s+)?{LETTERS}(?P<value>[a-z]+)\b",
    rf"\bcontain(?:s|ing)?\s+{LETTERS}(?P<value>[a-z]+)\b",
    r"\b(?:prefix|suffix)\s+(?:of\s+)?(?P<value>[a-z]+)\b",
    r"\b(?:letters?|characters?|substring)\s+(?P<value>[a-z]+)\b",
    r"(?<!\w)(?P<value>[%*][a-z]+[%*]?|[a-z]+[%*])(?!\w)",
    r"\b(?P<value>[a-z]+)\s+(?:anywhere|somewhere)\s+(?:in|within)\b",
    r"\b(?P<value>[a-z]+)\s+at\s+(?:the\s+)?(?:start|end|beginning)\b",
))


def map_profiles(words: Mapping[str, tuple[str, int]]) -> dict[str, tuple[dict[str, tuple[str, int]], tuple[tuple[str, str], ...]]]:
    """The four profiles of a rewriting: the word map, the phrase rules, both, and both with comparison signs."""
    signs = tuple((rf"\s*(?<![<>=!]){re.escape(sign)}(?![<>=!])\s*", f" {new} ") for sign, new in SYMBOLS)
    return {"domain": (dict(words), ()), "phrases": ({}, PHRASES), "combined": (dict(words), PHRASES), "combined_symbols": (dict(words), PHRASES + signs)}


class Normaliser:
    """Rewrites words by a map word -> (target, distance), outside protected spans and catalog values.

    Words of keep and trained must not be rewritten; where trained is given, every target must be one of its words."""

    def __init__(self, words: Mapping[str, tuple[str, int]], catalog: Sequence[str] = (), keep: Sequence[str] = (), rules: Sequence[tuple[str, str]] = PHRASES, trained: Sequence[str] = ()):
        bad = [w for w, (_, dist) in words.items() if w in {*keep, *trained} or not isinstance(dist, int) or dist < 0]
        if bad:
            raise ValueError(f"the map rewrites kept words or has no whole distance: {sorted(bad)[:5]}")
        lost = sorted(w for w, (target, _) in words.items() if trained and target not in set(trained))
        if lost:
            raise ValueError(f"targets are not among the trained words: {lost[:5]}")
        self.words, self.rules = dict(words), tuple(rules)
        self.phrases = set(c.lower() for c in catalog)
        self.longest = max((len(c.split()) for c in self.phrases), default=0)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Protected spans: quotes, numbers, pattern cues, and the longest catalog phrases."""
        out = [m.span("value" if "value" in p.groupindex else 0) for p in PROTECT for m in p.finditer(text)]
        tokens = [m for m in re.finditer(r"\S+", text)]
        i = 0
        while i < len(tokens):
            for k in range(min(self.longest, len(tokens) - i), 0, -1):
                if text[tokens[i].start() : tokens[i + k - 1].end()].lower().strip(".,?!") in self.phrases:
                    out.append((tokens[i].start(), tokens[i + k - 1].end()))
                    i += k - 1
                    break
            i += 1
        merged: list[tuple[int, int]] = []
        for a, b in sorted(out):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged

    def __call__(self, text: str | None) -> tuple[str | None, int]:
        """(text, changes)."""
        if text is None:
            return None, 0
        out, at, changes = [], 0, 0
        edges = [*self.spans(text), (len(text), len(text))]
        for a, b in edges:
            part, n = self._free(text[at:a])
            out += [part, text[a:b]]
            changes += n
            at = b
        return "".join(out), changes

    def _free(self, part: str) -> tuple[str, int]:
        n = 0
        for pattern, new in self.rules:
            part, k = re.subn(f"(?i){pattern}", new.replace("$", "\\"), part)
            n += k

        def one(m: re.Match) -> str:
            nonlocal n
            hit = self.words.get(m[0].lower())
            if hit is None or hit[0] == m[0].lower():
                return m[0]
            n += 1
            return hit[0]

        return re.sub(r"[^\W\d_]+", one, part), n


def normalise_texts(df: DataFrame, key: str, text: str, normaliser: Normaliser) -> DataFrame:
    """(key, text, changes) in Arrow batches; the map goes out with the function and is of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [normaliser(t) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "t": [x for x, _ in got], "changes": [n for _, n in got]})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, t string, changes int").toDF(key, text, "changes")


def swap_names(df: DataFrame, key: str, question: str, sql: str, pool: DataFrame, seed: int = 42) -> DataFrame:
    """Swaps the item name of a statement for another of its category, in text and statement alike, with its provenance.

    pool: (name, category). The new name is the next in the category's hashed cycle, so a name maps to the same other
    one everywhere. Rows whose question lacks the name, or whose category has one name, are left out.
    """
    cycle = pool.where("name is not null and category is not null").distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), "name")))
    w = Window.partitionBy("category").orderBy("h", "name")
    first = F.first("name").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mapped = cycle.withColumn("new_name", F.coalesce(F.lead("name").over(w), first)).where("new_name <> name").select(F.col("name").alias("old_name"), "new_name")
    named = df.withColumn("old_name", F.regexp_extract(sql, r"item_name\s*=\s*'([^']*)'", 1)).where("old_name <> ''")
    both = named.join(mapped, "old_name").where(F.contains(F.lower(question), F.col("old_name")))
    return both.select(
        key, replace_word(F.lower(question), F.col("old_name"), F.col("new_name")).alias("question"),
        F.replace(F.col(sql), F.concat(F.lit("'"), "old_name", F.lit("'")), F.concat(F.lit("'"), "new_name", F.lit("'"))).alias("sql"),
        F.col(question).alias("orig_question"), F.col(sql).alias("orig_sql"), "old_name", "new_name",
    )
