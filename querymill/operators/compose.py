"""Wording of statements from templates, and rule checks of a wording against its statement."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.dialect.catalog import Catalog
from querymill.dialect.statement import DialectError, Predicate, Statement, like_mode, parse

# Wordings per part of a statement.
OPENERS = ("show", "list", "give", "find")
OPS = {"=": ("is", "equal to"), "!=": ("not", "other than"), "<": ("below", "under", "less than"), ">": ("above", "over", "more than"), "<=": ("at most", "up to"), ">=": ("at least", "no less than")}
MODES = {"prefix": ("starts with", "begins with"), "suffix": ("ends with", "ends in"), "contains": ("contains", "has")}
FUNCTIONS = {"COUNT": ("number of", "how many"), "SUM": ("total",), "AVG": ("average", "mean"), "MIN": ("lowest", "minimum"), "MAX": ("highest", "maximum")}
CUES = {
    "COUNT": r"\b(count|number|how many|how often)\b", "SUM": r"\b(total|sum|summed|overall|altogether)\b", "AVG": r"\b(average|mean|typical)\b",
    "MIN": r"\b(lowest|minimum|min|smallest|least|cheapest|earliest|fewest)\b", "MAX": r"\b(highest|maximum|max|largest|most|biggest|dearest|latest)\b",
}
GROUP_CUE = r"\b(per|by|each|every|for each|split|break|broken|grouped)\b"
SORT_CUE = r"\b(first|top|highest|lowest|sorted|order(?:ed)? by|biggest|smallest|largest|latest|earliest|cheapest|most|least|rows)\b"


def _pick(options: Sequence[str], seed: str) -> str:
    return options[int(hashlib.md5(seed.encode()).hexdigest()[:8], 16) % len(options)]


def _value(v: object) -> str:
    return f"{v:g}" if isinstance(v, float) else str(v)


def _condition(p: Predicate, seed: str) -> str:
    name = p.column.replace("_", " ")
    if p.sub:
        fn = _pick(FUNCTIONS[p.sub.aggregate.function], seed)
        inner = " where " + " and ".join(_condition(c, seed) for c in p.sub.conds) if p.sub.conds else ""
        return f"{name} {_pick(OPS[p.op], seed)} the {fn} {name}{inner}"
    if p.op == "IN":
        return f"{name} {', '.join(_value(v) for v in p.values[:-1])} or {_value(p.values[-1])}"
    if p.op == "BETWEEN":
        return f"{name} between {_value(p.values[0])} and {_value(p.values[1])}"
    if p.op == "LIKE":
        mode, fragment = like_mode(str(p.values[0]))
        return f"{name} {_pick(MODES[mode], seed)} {fragment}"
    return f"{name} {_pick(OPS[p.op], seed)} {_value(p.values[0])}"


def wording(s: Statement, seed: str = "0") -> str:
    """A question for a statement: the same seed gives the same question, every literal is in it."""
    noun = s.table if s.limit != 1 else s.table.rstrip("s")
    if s.aggregate:
        fn = _pick(FUNCTIONS[s.aggregate.function], seed)
        what = f"{fn} {noun}" if s.aggregate.column == "*" else f"{fn} {s.aggregate.column.replace('_', ' ')} of {noun}"
        out = what + (f" per {s.group.replace('_', ' ')}" if s.group else "")
    else:
        what = f"{noun}" if s.select == "*" else f"{s.select.replace('_', ' ')} of {noun}"
        out = f"{_pick(OPENERS, seed)} {what}"
    if s.conds:
        out += " with " + (f" {(s.conn or 'AND').lower()} ").join(_condition(c, seed) for c in s.conds)
    if s.having:
        out += f", only where that is {_pick(OPS[s.having[0]], seed)} {_value(s.having[1])}"
    if s.order:
        out += f", {'highest' if s.order[1] == 'DESC' else 'lowest'} {s.order[0].lower()} first" if not s.aggregate else f", {'highest' if s.order[1] == 'DESC' else 'lowest'} first"
    return out + (f", top {s.limit}" if s.limit is not None else "")


def compose(df: DataFrame, key: str, sql: str, variants: int = 1) -> DataFrame:
    """(key, variant, question): wordings in Arrow batches; text outside the dialect has a null question."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["k"], b["s"]):
                for v in range(variants):
                    try:
                        rows.append((k, v, wording(parse(text or ""), f"{v}:{text}")))
                    except DialectError:
                        rows.append((k, v, None))
            yield pd.DataFrame(rows, columns=["k", "variant", "question"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(sql).alias("s")).mapInPandas(run, f"k {kind}, variant int, question string").withColumnRenamed("k", key)


def literal_problems(question: str, s: Statement) -> list[str]:
    """Literals of a statement (and its LIMIT) that a question lacks; numbers count by value."""
    text = question.lower()
    numbers = {float(x) for x in re.findall(r"(?<![\w.])\d+(?:\.\d+)?", re.sub(r"\d{4}-\d\d-\d\d", " ", text))}
    out = []
    for p in [c for c in s.conds] + [c for x in s.conds if x.sub for c in x.sub.conds]:
        if p.column == "stock" and p.op in ("=", ">") and p.values == (0,):
            continue  # worded as sold out or in stock
        for v in p.values:
            present = (str(v).strip("%").lower() in text) if isinstance(v, str) else float(v) in numbers
            if not present:
                out.append(f"{p.column}: {v}")
    if s.limit not in (None, 1) and float(s.limit) not in numbers:
        out.append(f"limit: {s.limit}")
    return out


def judge(question: str | None, sql: str | None, catalog: Catalog) -> tuple[str, list[str]]:
    """(verdict, evidence): violation, review or pass. A function, group, order or literal must have its cue in the question,
    and a cue for another function must not stand alone."""
    try:
        s = parse(sql or "")
    except DialectError:
        return "review", ["statement outside the dialect"]
    if not question or not question.strip():
        return "violation", ["no question"]
    text, wrong, odd = question.lower(), [], []
    if s.aggregate:
        cues = {f for f, pattern in CUES.items() if re.search(pattern, text)}
        if s.aggregate.function not in cues:
            (wrong if cues - {"MIN", "MAX"} else odd).append(f"no cue for {s.aggregate.function}")
        if s.group and not re.search(GROUP_CUE, text):
            odd.append("no cue for the group")
    for p in s.conds:
        if p.sub and not re.search(CUES[p.sub.aggregate.function], text):
            odd.append(f"no cue for the inner {p.sub.aggregate.function}")
    if s.order and not re.search(SORT_CUE, text):
        odd.append("no cue for the order")
    missing = literal_problems(question, s)
    wrong += [f"missing {m}" for m in missing]
    return ("violation" if wrong else "review" if odd else "pass"), wrong + odd


def judge_pairs(df: DataFrame, key: str, question: str, sql: str, catalog: Catalog) -> DataFrame:
    """(key, verdict, evidence) in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [judge(q, s, catalog) for q, s in zip(b["q"], b["s"])]
            yield pd.DataFrame({"k": b["k"], "verdict": [v for v, _ in got], "evidence": [e for _, e in got]})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(question).alias("q"), F.col(sql).alias("s")).mapInPandas(run, f"k {kind}, verdict string, evidence array<string>").withColumnRenamed("k", key)


def drop_reason(question: Column, sql: Column) -> Column:
    """First reason of a cascade of cheap cues, in the JVM; null keeps the record."""
    q = F.lower(question)
    fn = F.regexp_extract(F.upper(sql), r"\b(COUNT|SUM|AVG|MIN|MAX)\s*\(", 1)
    lacks = lambda f: (fn == f) & ~q.rlike(CUES[f])
    return (
        F.when(question.isNull() | sql.isNull(), "incomplete")
        .when(lacks("AVG"), "average without cue").when(lacks("SUM"), "sum without cue").when(lacks("COUNT"), "count without cue")
        .when(F.upper(sql).rlike(r"\bLIMIT 1\b") & ~q.rlike(SORT_CUE), "limit without cue")
        .when(F.upper(sql).rlike(r"\bGROUP BY\b") & ~q.rlike(GROUP_CUE), "group without cue")
    )


def variants_of(df: DataFrame, sql: str, catalog: Catalog) -> DataFrame:
    """(base, kind, text): the contrast variants of every distinct statement, in Arrow batches. Text outside the dialect has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["s"]:
                try:
                    s = parse(text)
                    rows += [(text, kind, v.render(catalog)) for kind, v in contrast_variants(s, catalog)]
                except (DialectError, KeyError):
                    continue
            yield pd.DataFrame(rows, columns=["base", "kind", "text"])

    return df.select(F.col(sql).alias("s")).where("s is not null").distinct().mapInPandas(run, "base string, kind string, text string")


def contrast_variants(s: Statement, catalog: Catalog) -> list[tuple[str, Statement]]:
    """Statements that differ from s in one respect: projection, comparison, ordering or LIKE mode."""
    from dataclasses import replace

    out: list[tuple[str, Statement]] = []
    t = catalog.tables[s.table]
    if s.kind == "flat":
        out += [("projection", replace(s, select=c)) for c in ("*", t.ident) if c and c != s.select]
    turn = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
    for i, c in enumerate(s.conds):
        if c.op in turn and not c.sub:
            out.append(("comparison", replace(s, conds=(*s.conds[:i], replace(c, op=turn[c.op]), *s.conds[i + 1 :]))))
        if c.op == "LIKE":
            mode, fragment = like_mode(str(c.values[0]))
            for other, form in (("prefix", f"{fragment}%"), ("suffix", f"%{fragment}"), ("contains", f"%{fragment}%")):
                if other != mode:
                    out.append(("like", replace(s, conds=(*s.conds[:i], replace(c, values=(form,)), *s.conds[i + 1 :]))))
    if s.order:
        out.append(("ordering", replace(s, order=(s.order[0], "ASC" if s.order[1] == "DESC" else "DESC"))))
    return out
