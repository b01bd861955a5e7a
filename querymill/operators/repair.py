"""Repair of damaged statements: keywords, then identifiers, then a strict parse."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.dialect.catalog import Catalog
from querymill.dialect.rules import violations
from querymill.dialect.statement import FUNCTIONS, KEYWORDS, DialectError, parse

PART = re.compile(r"'[^']*'|[A-Za-z_]\w*|\s+|.", re.S)


def edit_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def bigram_similarity(a: str, b: str) -> float:
    x, y = ({w[i : i + 2] for i in range(len(w) - 1)} for w in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def nearest(word: str, choices: list[str], score, least: float) -> str | None:
    """The best choice from least, ties to the earlier in order."""
    best = max(choices, key=lambda c: (score(word, c), [-ord(x) for x in c]), default=None)
    return best if best is not None and score(word, best) >= least else None


def repair_statement(text: str | None, catalog: Catalog, typo: float = 0.7, gram: float = 0.3) -> tuple[str | None, str]:
    """(canonical text, how): 'kept', 'repaired', or None with the reason it stays unreadable.

    Each identifier that the catalog lacks goes through a chain (edit ratio, then bigrams); the first change wins.
    """
    if text is None:
        return None, "no text"
    columns = sorted({c for t in catalog.tables.values() for c in t.columns} | set(catalog.tables))
    words = list(KEYWORDS + FUNCTIONS)
    out, changed = [], False
    for part in PART.findall(text):
        if not re.fullmatch(r"[A-Za-z_]\w*", part) or part.upper() in words or part.lower() in columns:
            out.append(part)
            continue
        low = part.lower()
        key = nearest(part.upper(), words, edit_ratio, 0.75) if "_" not in part else None
        name = nearest(low, columns, edit_ratio, typo) or nearest(low, columns, bigram_similarity, gram)
        if key and (not name or edit_ratio(part.upper(), key) >= edit_ratio(low, name)):
            name = key
        out.append(name or part)
        changed |= bool(name)
    try:
        s = parse("".join(out))
    except DialectError as e:
        return None, str(e)
    wrong = violations(s, catalog)
    return (None, wrong[0]) if wrong else (s.canonical(catalog).render(catalog), "repaired" if changed else "kept")


def repair_statements(df: DataFrame, key: str, sql: str, catalog: Catalog) -> DataFrame:
    """(key, repaired, how) in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [repair_statement(t, catalog) for t in b["s"]]
            yield pd.DataFrame({"k": b["k"], "repaired": [x for x, _ in got], "how": [h for _, h in got]})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(sql).alias("s")).mapInPandas(run, f"k {kind}, repaired string, how string").withColumnRenamed("k", key)


def parsed_statements(df: DataFrame, key: str, sql: str, catalog: Catalog) -> DataFrame:
    """(key, table_name, query_kind, select_cols, conn, n_conds, row_limit, skeleton, canonical, signature, violations): nulls for text outside the dialect."""
    ddl = "table_name string, query_kind string, select_cols string, conn string, n_conds int, row_limit int, skeleton string, canonical string, signature string, violations array<string>"

    def one(t: str | None) -> tuple:
        try:
            s = parse(t or "")
            c = s.canonical(catalog)
            return s.table, s.kind, s.output, c.conn, len(s.conds), s.limit, c.skeleton(catalog), c.render(catalog), c.signature(), violations(s, catalog)
        except (DialectError, KeyError):
            return (None,) * 9 + (["outside the dialect"],)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ddl.split(", ")]
        for b in batches:
            out = pd.DataFrame([one(t) for t in b["s"]], columns=names, index=b.index)
            out.insert(0, "k", b["k"])
            yield out.astype({"n_conds": "Int32", "row_limit": "Int32"})

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(sql).alias("s")).mapInPandas(run, f"k {kind}, {ddl}").withColumnRenamed("k", key)
