"""Subject areas of documents (problem 8) by class-association rules.

Texts are folded, cut into sentences and reduced to sets of terms by JVM expressions. Sentences of the labelled samples, as sets
of terms plus their subject, are mined by parallel frequent-pattern growth: every term gets the part of each sentence that is
more frequent than itself, and the patterns of a term are grown in its own task. A pattern with the counts of its subjects is a
rule; a rule is redundant, and pruned, when a shorter rule gives nearly the same shares of subjects. A specific rule that
*lowers* a share stays, so that figures of speech and filler phrases count as evidence for no subject. A sentence is scored by
the most specific rules it matches; scale and the weight of "no subject" are calibrated on held-out folds. A document has the
subjects that enough of its sentences deal with.

The samples are a bounded table (at most max_samples rows are used, by smallest id); everything else covers all rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.text import WORD, fold, let
from querymill.session import spread

TAG = r"(?i)</?[a-z][^<>]*>"
#: A sentence ends at a mark or a line break; an answer labelled by one letter ("q: ...? a: ...") stays with its question.
END = r"""(?:(?<=[.!…。])["')\]»”]*\s+|(?<=\?)["')\]»”]*\s+(?!\p{L}:)|[\r\n]+)"""
LEAD = r"""^[\s>*\-•|"'«“]+"""
#: A line of a label and one value at most, like the headers of a mail.
HEADER = r"^\p{L}[\p{L}-]*\s*:\s*\S*$"
#: Hangul words are stemmed to two syllables, which sheds particles.
HANGUL = r"(?<![\p{L}\p{N}])([가-힣][\p{L}\p{N}])[\p{L}\p{N}]+"


@dataclass(frozen=True)
class SubjectParams:
    """min_count: sentences a rule needs; max_terms: terms of a rule, 1 to 3; max_samples: bound of the labelled sample."""

    min_count: int = 3
    max_terms: int = 3
    max_samples: int = 20_000
    change: float = 0.1
    folds: int = 4
    sentence_share: float = 0.25


def sentences(text: Column) -> Column:
    """Sentences in folded form; an empty array for null or wordless text. Tags, quote marks and list marks are taken off and
    headers left out; a question and its answer are one sentence, and so is a line without end mark."""
    bare = F.when(text.contains("<"), F.regexp_replace(text, TAG, "\n")).otherwise(text)
    plain = F.when(bare.contains("&"), F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), bare)).otherwise(bare)
    parts = F.transform(F.split(fold(plain), END), lambda x: F.trim(F.regexp_replace(x, LEAD, "")))
    return F.filter(parts, lambda x: x.rlike(r"[\p{L}\p{N}]") & ~x.rlike(HEADER))


def terms(sentence: Column, vocabulary: Iterable[str] | None = None) -> Column:
    """Different words of a sentence (of vocabulary, if given), sorted. Numbers are left out, Hangul words stemmed."""
    stemmed = F.when(sentence.rlike("[가-힣]"), F.regexp_replace(sentence, HANGUL, "$1")).otherwise(sentence)
    words = F.regexp_extract_all(stemmed, F.lit(WORD), F.lit(0))
    keep = (lambda w: ~w.rlike(r"^\p{N}+$")) if vocabulary is None else (lambda w: w.isin(list(vocabulary)))
    return F.array_sort(F.array_distinct(F.filter(words, keep)))


@dataclass
class RuleModel:
    """rules: terms -> sentences per subject (and the total); scale and none: calibration.

    A rule whose shares may come from an even spread by chance (likelihood ratio under `significance`) is evidence for
    no subject.
    """

    subjects: list[str]
    rules: dict[frozenset[str], np.ndarray]
    scale: float = 1.0
    none: float = 0.0
    significance: float = 10.0
    index: dict[str, list[tuple[frozenset[str], np.ndarray]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        uses = Counter(t for r in self.rules for t in r)
        index = defaultdict(list)
        for r, counts in self.rules.items():
            total = counts[-1]
            k = len(self.subjects)
            raw = counts[:-1] / total
            gain = 2 * total * float((raw[raw > 0] * np.log(raw[raw > 0] * k)).sum())
            share = (counts[:-1] + 0.5 / k) / (total + 0.5) if gain >= self.significance else np.full(k, 1.0 / k)
            index[min(r, key=lambda t: (uses[t], t))].append((r, np.log(share / (1 - share)) + math.log(max(1, k - 1))))
        self.index = dict(index)
        self.vocabulary = set(uses)

    def evidence(self, ts: set[str]) -> np.ndarray:
        """Sum of log odds (against an even spread) over the most specific matching rules, each rule's weight divided
        among the rules that share its terms."""
        hit = [(r, v) for t in ts if t in self.index for r, v in self.index[t] if r <= ts]
        hit = [(r, v) for r, v in hit if not any(r < q for q, _ in hit)]
        if not hit:
            return np.zeros(len(self.subjects))
        cover = Counter(t for r, _ in hit for t in r)
        return sum(v * (sum(1.0 / cover[t] for t in r) / len(r)) for r, v in hit)

    def probabilities(self, evidence: np.ndarray) -> np.ndarray:
        """Per subject, and last for no subject."""
        z = np.r_[self.scale * evidence, self.none]
        z = np.exp(z - z.max())
        return z / z.sum()

    def subject(self, key: str) -> int:
        """Index of the subject that a sentence (its terms, parted by blanks) deals with, -1 for none."""
        return int(self.subjects_of(pa.array([" ".join(sorted(set(key.split())))]))[0])

    def subjects_of(self, keys: pa.Array) -> np.ndarray:
        """subject() of many sentences at once; the terms of each are different and sorted.

        Patterns are found by position: every term that is a rule, every two terms of a sentence that are one, and every
        term behind two that begin one of three. The rest follows evidence() and probabilities().
        """
        n, k = len(keys), len(self.subjects)
        tables, scores = self.tables
        known = pc.index_in(pc.list_flatten(split := pc.utf8_split_whitespace(keys)), value_set=pa.array(tables["terms"], pa.string()))
        known = known.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        owner, term = owner[known >= 0], known[known >= 0]
        m, size = len(term), len(tables["terms"]) + 1
        if not m:
            return np.full(n, -1)
        end = np.searchsorted(owner, owner, side="right")

        def look(codes: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(among):
                return np.empty(0, np.int64), np.empty(0, np.int64)
            at = np.minimum(np.searchsorted(among, codes), len(among) - 1)
            hit = np.flatnonzero(among[at] == codes)
            return hit, at[hit]

        def later(live: np.ndarray, after: np.ndarray):
            """Index into live, and a position behind after of the same sentence, in steps."""
            other, at = after + 1, np.arange(len(live))
            while len(keep := np.flatnonzero(other < end[live[at]])):
                other, at = other[keep], at[keep]
                yield at, other
                other = other + 1

        pairs, begun, triples = [], [], []
        for at, other in later(np.arange(m), np.arange(m)):
            code = term[at] * size + term[other]
            hit, rule = look(code, tables["pairs"])
            pairs.append(np.c_[rule, at[hit], other[hit]])
            hit, _ = look(code, tables["begins"])
            begun.append(np.c_[at[hit], other[hit]])
        pairs, begun = (np.concatenate(x) if x else np.empty((0, w), np.int64) for x, w in ((pairs, 3), (begun, 2)))
        for at, other in later(begun[:, 0], begun[:, 1]):
            hit, rule = look((term[begun[at, 0]] * size + term[begun[at, 1]]) * size + term[other], tables["triples"])
            triples.append(np.c_[rule, begun[at[hit]], other[hit]])
        triples = np.concatenate(triples) if triples else np.empty((0, 4), np.int64)
        inside = np.zeros(m, bool)
        inside[pairs[:, 1:].ravel()] = inside[triples[:, 1:].ravel()] = True
        inner = np.concatenate([triples[:, i] * m + triples[:, j] for i, j in ((1, 2), (1, 3), (2, 3))])
        pairs = pairs[~np.isin(pairs[:, 1] * m + pairs[:, 2], inner)]
        hit, rule = look(term, tables["singles"])
        singles = np.c_[rule, hit][~inside[hit]]
        found = [(name, x[:, 0], x[:, 1:]) for name, x in (("singles", singles), ("pairs", pairs), ("triples", triples)) if len(x)]
        cover = np.bincount(np.concatenate([pos.ravel() for _, _, pos in found] or [np.empty(0, np.int64)]), minlength=m)
        evidence = np.zeros((n, k))
        for name, rule, pos in found:
            weight, who = (1.0 / cover[pos]).mean(axis=1), owner[pos[:, 0]]
            for j in range(k):
                evidence[:, j] += np.bincount(who, weights=weight * scores[name][rule, j], minlength=n)
        z = np.c_[self.scale * evidence, np.full(n, self.none)]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        best = z[:, :k].argmax(axis=1)
        return np.where(2 * z[np.arange(n), best] >= z.sum(axis=1), best, -1)

    @cached_property
    def tables(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Rules of one, two and three terms as sorted codes, and their log odds in the same order."""
        terms = sorted(self.vocabulary)
        at, size = {t: i for i, t in enumerate(terms)}, len(terms) + 1
        coded: dict[int, list[tuple[int, np.ndarray]]] = {1: [], 2: [], 3: []}
        for rules in self.index.values():
            for r, v in rules:
                code = 0
                for t in sorted(r):
                    code = code * size + at[t]
                coded[len(r)].append((code, v))
        names = {1: "singles", 2: "pairs", 3: "triples"}
        tables = {names[i]: np.array(sorted(c for c, _ in x), np.int64) for i, x in coded.items()}
        scores = {names[i]: np.array([v for _, v in sorted(x, key=lambda y: y[0])]).reshape(len(x), len(self.subjects)) for i, x in coded.items()}
        return tables | {"terms": terms, "begins": np.unique(tables["triples"] // size)}, scores


def mine(spark, runs: list[list[tuple[set[str], str]]], subjects: list[str], p: SubjectParams) -> list[dict[frozenset[str], np.ndarray]]:
    """For each run of (terms, subject) transactions its non-redundant rules. All runs are mined in one job.

    A transaction's terms are ordered from the most frequent one on; the task of a term sees the part before it and grows the
    patterns that end in the term, to max_terms at most, from those that reach min_count.
    """
    at = {s: i for i, s in enumerate(subjects)}
    rows = []
    for run, transactions in enumerate(runs):
        freq = Counter(t for ts, _ in transactions for t in ts)
        for ts, s in transactions:
            order = sorted((t for t in ts if freq[t] >= p.min_count), key=lambda t: (-freq[t], t))
            if order:
                rows.append((run, order, at[s]))
    if not rows:
        return [{} for _ in runs]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["run", "items", "y"]), "run int, items array<string>, y int").repartition(spark.sparkContext.defaultParallelism)
    ends = df.select("run", "y", F.posexplode("items").alias("i", "term"), "items").select("run", "y", "term", F.slice("items", F.lit(1), F.col("i")).alias("before"))
    per_term = ends.groupBy("run", "term").agg(F.collect_list("before").alias("before"), F.collect_list("y").alias("ys"))  # bounded by the labelled sample
    k, least, deepest = len(subjects), p.min_count, p.max_terms

    def grow(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []

            def extend(run: int, pattern: list[str], base: list[tuple[list[str], int]]) -> None:
                counts = [0] * k
                for _, y in base:
                    counts[y] += 1
                out.append((run, pattern, counts))
                if len(pattern) == deepest:
                    return
                inner = defaultdict(list)
                for before, y in base:
                    for j, t in enumerate(before):
                        inner[t].append((before[:j], y))
                for t, sub in inner.items():
                    if len(sub) >= least:
                        extend(run, [*pattern, t], sub)

            for run, term, before, ys in zip(batch["run"], batch["term"], batch["before"], batch["ys"]):
                extend(int(run), [term], [(list(x), int(y)) for x, y in zip(before, ys)])
            yield pd.DataFrame(out, columns=["run", "pattern", "counts"])

    found: list[dict[frozenset[str], np.ndarray]] = [{} for _ in runs]
    grown = per_term.mapInPandas(grow, "run int, pattern array<string>, counts array<long>")
    for r in grown.collect():  # bounded by the labelled sample
        found[r["run"]][frozenset(r["pattern"])] = np.array([*r["counts"], sum(r["counts"])], float)
    return [prune(f, p) for f in found]


def prune(found: dict[frozenset[str], np.ndarray], p: SubjectParams) -> dict[frozenset[str], np.ndarray]:
    """Keeps a rule when its shares differ by `change` or more from those of every kept shorter rule inside it."""
    kept: dict[frozenset[str], np.ndarray] = {}
    share = lambda c: c[:-1] / max(c[-1], 1.0)
    for r in sorted(found, key=lambda r: (len(r), -found[r][-1], sorted(r))):
        mine_ = share(found[r])
        inner = [kept[q] for q in _subsets(r) if q in kept]
        if all(np.abs(mine_ - share(c)).max() >= p.change for c in inner):
            kept[r] = found[r]
    return kept


def _subsets(r: frozenset[str]) -> Iterator[frozenset[str]]:
    items = sorted(r)
    for mask in range(1, (1 << len(items)) - 1):
        yield frozenset(x for i, x in enumerate(items) if mask >> i & 1)


def calibrate(held: list[tuple[np.ndarray, int]], n_subjects: int) -> tuple[float, float]:
    """Scale and weight of "no subject" with the best held-out likelihood of the samples' labels, where a sentence of
    no subject says nothing of the label. held: evidence and label of each held-out sentence."""
    if not held:
        return 1.0, 0.0
    ev, label = np.array([e for e, _ in held]), np.array([y for _, y in held])
    best = (-math.inf, 1.0, 0.0)
    for scale in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        for none in np.arange(-1.0, 8.1, 0.5):
            z = np.c_[scale * ev, np.full(len(ev), none)]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            ll = np.log(z[np.arange(len(z)), label] + z[:, -1] / n_subjects).mean()
            if ll > best[0] + 1e-9:
                best = (ll, scale, float(none))
    return best[1], best[2]


def labelled_sentences(samples: DataFrame, p: SubjectParams = SubjectParams()) -> list[tuple[list[set[str]], str]]:
    """The terms of every sentence of each labelled text, and its subject, by sample_id. Rows without subject are left out."""
    some = samples.where("subject is not null").orderBy("sample_id").limit(p.max_samples)
    rows = some.select("sample_id", "subject", F.transform(sentences(F.col("text")), lambda x: terms(x)).alias("t")).collect()
    return [([set(ts) for ts in r["t"]], r["subject"]) for r in sorted(rows, key=lambda r: r["sample_id"])]


def fit(samples: DataFrame, p: SubjectParams = SubjectParams()) -> RuleModel:
    """samples: (sample_id, subject, text). Without labelled rows the model knows no subject."""
    texts = labelled_sentences(samples, p)
    subjects = sorted({s for _, s in texts})
    flat = lambda fold_: [(ts, s) for i, (sents, s) in enumerate(texts) if i % p.folds != fold_ for ts in sents]
    *parts, rules = mine(samples.sparkSession, [flat(f) for f in range(p.folds)] + [flat(-1)], subjects, p)
    held = []
    for f, found in enumerate(parts):
        model = RuleModel(subjects, found)
        held += [(model.evidence(ts), subjects.index(s)) for i, (sents, s) in enumerate(texts) if i % p.folds == f for ts in sents]
    scale, none = calibrate(held, len(subjects))
    return RuleModel(subjects, rules, scale, none)


def score_documents(docs: DataFrame, model: RuleModel) -> DataFrame:
    """(doc_id, n_sentences, subject, n_about): per document and subject met, the sentences that deal with it.

    A document without sentences, or with none on any subject, has one row with a null subject and 0. Sentences come to
    Python as the terms that rules use; equal ones are scored once a batch.
    """
    state = (model.subjects, model.rules, model.scale, model.none)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = RuleModel(*state)
        names, k = [*m.subjects, None], len(m.subjects)
        for batch in batches:
            n, keys = batch.num_rows, batch.column(1)
            sizes = np.diff(keys.offsets.to_numpy(zero_copy_only=False))
            coded = keys.flatten().dictionary_encode()
            known = m.subjects_of(coded.dictionary) if k else np.full(len(coded.dictionary), -1)
            about = known[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.empty(0, np.int64)
            owner = np.repeat(np.arange(n), sizes)
            counts = np.bincount((owner * (k + 1) + about)[about >= 0], minlength=n * (k + 1)).reshape(n, k + 1)
            counts[counts.sum(axis=1) == 0, k] = -1
            doc, subject = np.nonzero(counts)
            number = np.maximum(counts[doc, subject], 0)
            yield pa.record_batch(
                [batch.column(0).take(pa.array(doc)), pa.array(sizes[doc].astype(np.int64)), pa.array([names[j] for j in subject.tolist()], pa.string()), pa.array(number.astype(np.int64))],
                names=["doc_id", "n_sentences", "subject", "n_about"],
            )

    text = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    key = F.transform(sentences(F.col("text")), lambda x: F.array_join(terms(x, sorted(model.vocabulary)), " "))
    return text.select("doc_id", key.alias("keys")).mapInArrow(run, "doc_id long, n_sentences long, subject string, n_about long")


def document_subjects(docs: DataFrame, samples: DataFrame, p: SubjectParams = SubjectParams()) -> DataFrame:
    """(doc_id, subject, share): the subjects that at least sentence_share of a document's sentences deal with."""
    scored = score_documents(docs, fit(samples, p))
    share = F.col("n_about") / F.col("n_sentences")
    return scored.where(F.col("subject").isNotNull() & (F.col("n_about") >= p.sentence_share * F.col("n_sentences"))).select("doc_id", "subject", F.round(share, 6).alias("share"))


def subject_composition(docs: DataFrame, samples: DataFrame, areas: DataFrame, p: SubjectParams = SubjectParams()) -> DataFrame:
    """Per subject area: documents about it, sentences about it, and its share of all documents and sentences."""
    scored = score_documents(docs, fit(samples, p))
    one = scored.groupBy("doc_id", "n_sentences").agg(F.count(F.lit(1)).alias("k"))
    total = one.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_sentences"), F.lit(0)).alias("sents"))
    is_about = F.col("n_about") >= p.sentence_share * F.col("n_sentences")
    per = scored.where("subject is not null").groupBy("subject").agg(F.count_if(is_about).alias("n_documents"), F.sum("n_about").alias("n_sentences"))
    got = areas.select("subject").distinct().join(per, "subject", "left").withColumns({c: total.select(c).scalar() for c in ("docs", "sents")})
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return got.select(
        "subject", count("n_documents").alias("n_documents"), count("n_sentences").alias("n_sentences"),
        F.round(count("n_documents") / F.col("docs"), 6).alias("document_share"), F.round(count("n_sentences") / F.col("sents"), 6).alias("sentence_share"),
    )
