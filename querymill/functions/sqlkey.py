"""Canonical key of a dialect statement as one JVM-side expression, for keys over whole tables.

Two texts get the same key when they differ only in keyword case, layout, closing semicolon, order of conditions
joined by one AND or OR, order of IN values, ``<>`` for ``!=`` and number format. String literals are kept as they are.
Text outside the dialect gets its token sequence as key; null stays null. ``dialect.statement`` is the strict parser
for single statements; a test holds the two against each other.

Plainly written texts (most of them) are canonicalised by string replacement; texts with unusual literals or numbers go
through their tokens. Both ways give the same key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.text import let

MARK = "\x01"
TOKEN = r"'(?:[^']|'')*'|[A-Za-z_][A-Za-z_0-9]*|[0-9]+(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+|<=|>=|<>|!=|[^\s;]"
#: Plain: literals of small letters, digits and single spaces, without the words that split a statement; numbers like 12 or 12.50.
PLAIN = r"^(?:[^'.]|'[a-z0-9%_-]+(?: (?!(?:and|or|in|between|where|group|order|limit) )[a-z0-9%_-]+)*'|(?<=[0-9])\.(?=[0-9]))*+$"
ODD = r"[0-9][A-Za-z_]|(?<![0-9])[-+]\s*[0-9]|(?<![0-9.'-])0[0-9]|[\x{1}-\x{3}]|;.*\S"


def _condition(cond: Column, s: str) -> Column:
    """IN values in order."""
    mark = f"{s}in{s}({s}"
    at = F.instr(cond, mark)
    values = F.split(F.substring_index(F.substr(cond, at + len(mark)), f"{s})", 1), f"{s},{s}")
    listed = F.concat(F.substring_index(cond, mark, 1), F.lit(mark), F.array_join(F.sort_array(values), f"{s},{s}"), F.lit(f"{s})"))
    return F.when(at > 0, listed).otherwise(cond)


def _clause(text: Column, s: str) -> Column:
    """Sorts the conditions of the WHERE of one SELECT; mixed connectors keep their order."""
    where = f"{s}where{s}"
    at = F.instr(text, where)

    def sort(parts: Column) -> Column:
        body = parts[0]
        has_or, has_and = body.contains(f"{s}or{s}"), body.contains(f"{s}and{s}")
        conds = F.sort_array(F.transform(F.split(body, f"{s}(?:and|or){s}"), lambda c: _condition(c, s)))
        joined = F.when(has_or, F.array_join(conds, f"{s}or{s}")).otherwise(F.array_join(conds, f"{s}and{s}"))
        tail = F.when(F.size(parts) > 1, F.concat(F.lit(s), parts[1])).otherwise(F.lit(""))
        return F.when(has_or & has_and, text).otherwise(F.concat(F.substring_index(text, where, 1), F.lit(where), joined, tail))

    rest = F.split(F.substr(text, at + len(where)), f"{s}(?=group{s}by{s}|order{s}by{s}|limit{s})", 2)
    return F.when(at > 0, let(rest, sort)).otherwise(text)


def _whole(text: Column, s: str) -> Column:
    """text (a bound variable, so cheap to repeat): tokens joined by s. A subselect is taken out, arranged by itself and put behind."""
    sub = rf"\({s}(select{s}(?:[^()]|\([^()]*\))*){s}\)"
    operand = rf"(?:-{s})?(?:'(?:[^']|'')*'|[^{s}]+)"
    flat = F.when(text.contains(f"{s}between{s}"), F.regexp_replace(text, rf"{s}between{s}({operand}){s}and{s}({operand})", f"{s}between{s}$1\x02$2")).otherwise(text)

    def arrange(t: Column) -> Column:
        outer = let(F.regexp_replace(t, sub, "\x03"), lambda x: _clause(x, s))
        inner = let(F.regexp_extract(t, sub, 1), lambda x: _clause(x, s))
        return F.when(t.contains(f"({s}select{s}"), F.concat(outer, F.lit("\x03"), inner)).otherwise(_clause(t, s))

    return let(flat, arrange)


def _by_tokens(sql: Column) -> Column:
    def token(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        number = t.try_cast("double")
        plain = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
        return (
            F.when(first == "'", t)
            .when(first.between("0", "9") | (first == "."), F.coalesce(plain, t))
            .when(t == "<>", F.lit("!="))
            .otherwise(F.lower(t))
        )

    tokens = F.transform(F.regexp_extract_all(sql, F.lit(TOKEN), F.lit(0)), token)
    return F.translate(let(F.array_join(tokens, MARK), lambda t: _whole(t, MARK)), MARK, " ")


def _by_replacement(sql: Column) -> Column:
    spaced = F.regexp_replace(F.regexp_replace(F.lower(sql), r"\s*(<=|>=|<>|!=|[=<>(),*;])\s*", " $1 "), r"\s+", " ")

    def numbers(s: Column) -> Column:
        return F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*[1-9])0+(?![0-9])", "$1"), r"\.0+(?![0-9])", "")).otherwise(s)

    plain = F.replace(F.rtrim(F.trim(spaced), F.lit("; ")), F.lit("<>"), F.lit("!="))
    return let(let(plain, numbers), lambda t: _whole(t, " "))


def is_plain(sql: Column) -> Column:
    return sql.rlike(PLAIN) & ~sql.rlike(ODD)


def sql_key(sql: Column) -> Column:
    return F.when(sql.isNull(), F.lit(None).cast("string")).when(is_plain(sql), _by_replacement(sql)).otherwise(_by_tokens(sql))
