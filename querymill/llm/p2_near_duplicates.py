"""Near-duplicate questions with small edits (problem 2).

Two ways find candidates; every candidate is verified exactly on its bags of words.

*Stars.* One-permutation signatures with optimal densification are cut into bands; the texts of a bucket are tied to its
smallest text only, so candidates are never more than texts x bands. Classes of near-duplicates begin with the verified
star links, in which a group of any size costs as many links as it has texts.

*Prefix filter.* Bands miss some pairs at the bound and stars list few of the pairs of a group, so neither can give every
close pair. All elements of bags are put into one order, rare ones first. Two bags that must have o elements in common share
their first k common elements within the first n - o + k elements of either, so texts meet in a bucket for every
combination of k elements of that prefix, and each close pair shares a bucket. k falls with the length, which keeps the
combinations few. Every two texts of a bucket are compared by size and by an odd sketch, whose Hamming distance never
exceeds the true difference of two bags: no close pair is lost, for any order of the elements and any k. Buckets that
a sample shows to be large are dealt to several tasks as a grid of blocks. Classes look only for links between different
star classes this way.

A row of a bucket is two numbers: the key with the size, and the node. A node is a bag's 48-bit odd sketch with 16 bits of its
hash; bags that agree in it are told apart by 128 bits and renamed before anything is compared (with_nodes).

Copies (equal bags) are one node throughout; they are expanded only where a query asks for pairs of records.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.operators.components import connected_components
from querymill.session import materialize

EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearDupParams:
    """num/den is the share of the longer bag that must be common; classes are (least length, elements of a key) by length.

    bands x rows are the bins of the one-permutation signature. hot_rows is the size of a block of a large bucket; buckets
    are sized over one bag in `sampled`, at most hot_keys of them. hot_rows and task_rows move work between tasks and change no result.
    """

    bands: int = 18
    rows: int = 5
    num: int = 4
    den: int = 5
    classes: tuple[tuple[int, int], ...] = ((1, 1), (4, 3), (15, 2), (100, 1))
    ranked: int = 65_536  # most frequent elements whose counts order them; all others are rare and ordered by hash
    keys: int = 1 << 18  # keys, or pairs, made at once
    hot_rows: int = 1 << 14
    task_rows: int = 1 << 19  # most rows of buckets for one task, about
    least_tasks: int = 256  # where there are rows enough, so that buckets spread evenly
    hot_keys: int = 1 << 16
    sampled: int = 64


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def one_permutation_bands(values: np.ndarray, lengths: np.ndarray, p: NearDupParams) -> np.ndarray:
    """Band hashes (sets x bands, uint64) of sets given as flat int64 values and lengths >= 1.

    Optimal densification: an empty bin takes the value of the first filled one in a random sequence of bins, which is its own
    and the same for all sets.
    """
    n, k = len(lengths), p.bands * p.rows
    owner = np.repeat(np.arange(n), lengths)
    h = _mix(values.astype(np.int64).view(np.uint64))
    bins = ((h & np.uint64(0xFFFFFFFF)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    sig = np.full(n * k, EMPTY)
    np.minimum.at(sig, owner * k + bins, _mix(h))
    filled = sig != EMPTY
    out, todo, probe = sig.copy(), np.flatnonzero(~filled), np.uint64(0x51ED270B)
    while len(todo):
        probe = _mix(np.array([probe]))[0]
        step = (_mix(np.arange(k, dtype=np.uint64) ^ probe) >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
        donor = todo - todo % k + step.astype(np.int64)[todo % k]
        ok = filled[donor]
        out[todo[ok]] = sig[donor[ok]]
        todo = todo[~ok]
    out = out.reshape(n, p.bands, p.rows)
    band = np.broadcast_to(_mix(np.arange(p.bands, dtype=np.uint64)), (n, p.bands))
    for r in range(p.rows):
        band = _mix(band ^ out[:, :, r])
    return band


def _allowed(n1: np.ndarray, n2: np.ndarray, p: NearDupParams) -> np.ndarray:
    """The largest symmetric difference two close bags of these sizes can have."""
    need = -(-p.num * np.maximum(n1, n2) // p.den)
    return n1 + n2 - 2 * need


#: place of a row: 40 bits of the key, 20 of the size, 2 of the block side, 2 of the sides. Two buckets that agree in 40 bits only
#: add candidates, and so does a size that does not fit. Sides: 1 on the first side, 2 on the second, 3 both. Block side: 0 for a
#: whole bucket or a block on the diagonal of its grid, 1 and 2 for the two chunks that a block off the diagonal compares.
KEY_BITS = np.uint64(0xFFFFFFFFFF000000)
WIDE = (1 << 20) - 1
#: Rows travel packed: those of a batch that go to one task are one value, their places, nodes (and grps) as columns of LONG.
PACK, PACK_DDL = pa.schema([("part", pa.int32()), ("n", pa.int32()), ("rows", pa.binary())]), "part int, n int, rows binary"
PAIR = pa.schema([("xa", pa.int64()), ("xb", pa.int64())])
PAIR_DDL = "xa long, xb long"


def _np(col) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False)


def with_nodes(table: DataFrame) -> DataFrame:
    """table with nodes that stand for one bag each: where several bags (b1, b2) have one node, all but one take another
    hash beside their sketch, until no two agree. One aggregation where, as nearly always, none do."""
    for salt in range(8):
        clash = table.select("node", F.struct("b1", "b2").alias("b")).groupBy("node").agg(F.min("b").alias("__lo"), F.max("b").alias("__hi"))
        clash = materialize(clash.where("__lo <> __hi").select("node", "__lo"), "clashes")
        if clash.isEmpty():
            return table
        sketch = F.col("node").bitwiseAND(F.lit(~0xFFFF).cast("long"))
        other = sketch.bitwiseOR(F.xxhash64(F.lit(salt), "b1", "b2").bitwiseAND(F.lit(0xFFFF)))
        own = F.col("__lo").isNull() | (F.struct("b1", "b2") == F.col("__lo"))
        table = table.join(clash, "node", "left").withColumn("__node", F.when(own, F.col("node")).otherwise(other)).drop("node", "__lo").withColumnRenamed("__node", "node")
    raise RuntimeError("bags could not be told apart")


def element_ranks(table: DataFrame, p: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements, sorted, and their places by count; from an eighth of the bags, as any order is right."""
    some = table.where(F.pmod(F.xxhash64("node"), F.lit(8)) == 0).select(F.explode("els").alias("e"))
    top = some.groupBy("e").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "e").limit(p.ranked).toArrow()
    e = top.column("e").to_numpy()
    place = np.arange(len(e), 0, -1, dtype=np.uint32)
    by = np.argsort(e)
    return e[by], place[by]


def _sorted_bags(values: np.ndarray, lengths: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes of the elements, in each bag the rare ones first."""
    h = _mix(values.astype(np.int64).view(np.uint64))
    place = np.zeros(len(values), np.uint32)
    known, at = ranks
    if len(known):
        i = np.minimum(np.searchsorted(known, values), len(known) - 1)
        place = np.where(known[i] == values, at[i], np.uint32(0))
    return h[np.lexsort((h, place, np.repeat(np.arange(len(lengths)), lengths)))]


def prefix_keys(values: np.ndarray, lengths: np.ndarray, ranks: tuple[np.ndarray, np.ndarray], p: NearDupParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (bag index, key). Two close, different bags share a key; those of a pair are in the class of the longer one."""
    h = _sorted_bags(values, lengths, ranks)
    starts = np.cumsum(lengths) - lengths
    for c, (low, k) in enumerate(p.classes):
        high = p.classes[c + 1][0] if c + 1 < len(p.classes) else None
        k = min(k, -(-p.num * low // p.den))
        in_class = lengths * p.den // p.num >= low
        if high is not None:
            in_class &= lengths < high
        for n in np.unique(lengths[in_class]).tolist():
            who = np.flatnonzero(in_class & (lengths == n))
            width = min(n, n - -(-p.num * n // p.den) + k)
            if width < k:
                continue
            combos = np.array(list(combinations(range(width), k)), np.int64)
            for block in np.array_split(combos, -(-len(combos) // p.keys)):
                step = max(1, p.keys // len(block))
                for at in range(0, len(who), step):
                    some = who[at : at + step]
                    prefix = h[starts[some][:, None] + np.arange(width)]
                    key = np.full((len(some), len(block)), _mix(np.array([c], np.uint64))[0])
                    for j in range(k):
                        key = _mix(key ^ prefix[:, block[:, j]])
                    yield np.repeat(some, len(block)), key.ravel()


def map_side(p: NearDupParams, ranks: tuple[np.ndarray, np.ndarray], tasks: int, hot: tuple[np.ndarray, np.ndarray] | None = None):
    """Packs of a row for each key of each bag (node, els, sides, maybe grp); rows of a hot bucket go to every block of their chunk.
    With tasks 0, the buckets alone: (bucket)."""

    def rows_of(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return key, at, np.zeros(len(key), np.int64)

    def in_grid(key: np.ndarray, at: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, grid = hot
        i = np.minimum(np.searchsorted(known, key), len(known) - 1)
        is_hot = known[i] == key
        if not is_hot.any():
            return rows_of(key, at)
        keys, owners, sides = [key[~is_hot]], [at[~is_hot]], [np.zeros(int((~is_hot).sum()), np.int64)]
        hot_key, hot_at, g = key[is_hot], at[is_hot], grid[i[is_hot]]
        chunk = (_mix(node[hot_at].view(np.uint64) ^ hot_key) % g.astype(np.uint64)).astype(np.int64)
        for other in range(int(g.max())):
            some = other < g
            c = chunk[some]
            lo, hi = np.minimum(c, other), np.maximum(c, other)
            keys.append(_mix(_mix(hot_key[some] ^ lo.astype(np.uint64)) + hi.astype(np.uint64)) & KEY_BITS)
            owners.append(hot_at[some])
            sides.append(np.where(c == other, 0, np.where(c < other, 1, 2)))
        return np.concatenate(keys), np.concatenate(owners), np.concatenate(sides)

    def packed(made: list[list[np.ndarray]]) -> pa.RecordBatch:
        rows = [np.concatenate(x) for x in zip(*made)]
        if not tasks:
            return pa.record_batch([pa.array(rows[0] >> 24)], names=["bucket"])
        part = (_mix((rows[0] >> 24).view(np.uint64)) % np.uint64(tasks)).astype(np.int32)
        by = np.lexsort((rows[0], part))
        part, rows = part[by], [x[by] for x in rows]
        ends = np.r_[np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        starts = np.r_[0, ends[:-1]]
        values = [b"".join(x[a:b].tobytes() for x in rows) for a, b in zip(starts.tolist(), ends.tolist())]
        return pa.record_batch([pa.array(part[starts]), pa.array((ends - starts).astype(np.int32)), pa.array(values, pa.binary())], schema=PACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, sides = _np(batch.column(0)), _np(batch.column(2))
            by = np.lexsort((sides, node))
            once = by[np.r_[True, (node[by][1:] != node[by][:-1]) | (sides[by][1:] != sides[by][:-1])]]
            batch = batch.take(pa.array(once))
            node, els, sides = _np(batch.column(0)), batch.column(1), _np(batch.column(2)).astype(np.int64)
            own, made, n = [_np(batch.column(3))] if batch.num_columns > 3 else [], [], 0
            lengths, values = np.diff(_np(els.offsets)).astype(np.int64), _np(els.flatten())
            size = np.minimum(lengths, WIDE)
            for at, key in prefix_keys(values, lengths, ranks, p):
                key = key & KEY_BITS
                key, at, side = in_grid(key, at, node) if hot is not None and len(hot[0]) else rows_of(key, at)
                place = key.view(np.int64) | (size[at] * 16 + side * 4 + sides[at])
                made.append([place, node[at], *[g[at] for g in own]])
                n += len(place)
                if n >= p.keys * 2:
                    yield packed(made)
                    made, n = [], 0
            if n:
                yield packed(made)

    return run


def bucket_sizes(bags: DataFrame, ranks: tuple[np.ndarray, np.ndarray], p: NearDupParams) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """From a sample of bags: keys, sorted, of buckets that hold about 2 x hot_rows rows or more, with the chunks to part each
    into; and about how many rows all buckets hold."""
    some = bags.select("node", "els", "sides").where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(p.sampled)) == 0)
    rows = some.mapInArrow(map_side(p, ranks, 0), "bucket long")
    counts = materialize(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")), "bucket-sizes")
    total = int(counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]) * p.sampled
    top = counts.where(F.col("c") * p.sampled >= 2 * p.hot_rows).orderBy(F.desc("c"), "bucket").limit(p.hot_keys).toArrow()
    key = (top.column("bucket").to_numpy() << 24).view(np.uint64)
    chunks = np.minimum(-(-top.column("c").to_numpy() * p.sampled // p.hot_rows), 64)
    by = np.argsort(key)
    return (key[by], chunks[by]), total


def bucket_pairs(place: np.ndarray, node: np.ndarray, grp: np.ndarray | None, p: NearDupParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one bucket, of different nodes and grp, whose sizes and sketches allow them to be close, as blocks.

    Rows are sorted by bucket, and by grp if given: a row then meets the rows behind the last one of its grp, so rows of one grp
    are never compared.
    """
    n, bucket = len(place), place >> 24
    behind = np.arange(1, n + 1)
    if grp is not None:
        last = np.r_[np.flatnonzero((bucket[1:] != bucket[:-1]) | (grp[1:] != grp[:-1])), n - 1]
        behind = last[np.searchsorted(last, np.arange(n))] + 1
    end = np.searchsorted(bucket, bucket, side="right")
    live = np.flatnonzero(behind < end)
    other = behind[live]
    size, block, sides, sketch = (place >> 4) & WIDE, (place >> 2) & 3, place & 3, node.view(np.uint64) >> np.uint64(16)
    while len(live):
        allowed = _allowed(size[live], size[other], p)
        ok = (np.bitwise_count(sketch[live] ^ sketch[other]) <= allowed) | ((size[live] == WIDE) | (size[other] == WIDE))
        i, j = live[ok], other[ok]
        a, b = sides[i], sides[j]
        ok = (node[i] != node[j]) & ((block[i] == 0) | (block[i] != block[j])) & ((a & 1) * (b & 2) + (a & 2) * (b & 1) > 0)
        if ok.any():
            yield i[ok], j[ok]
        other = other + 1
        keep = other < end[live]
        live, other = live[keep], other[keep]


def reduce_side(p: NearDupParams):
    """Pairs over all packs of a task, about task_rows rows.

    Sided pairs come as (node of side 1, node of side 2), others with the smaller node first.
    """

    def out(found: list[tuple[np.ndarray, np.ndarray]], node: np.ndarray, sides: np.ndarray) -> pa.RecordBatch:
        i, j = (np.concatenate(x) for x in zip(*found))
        free = (sides[i] == 3) & (sides[j] == 3)
        a, b = node[i], node[j]
        turn = np.where(free, a > b, (sides[i] & 1 == 0) | (sides[j] & 2 == 0))
        xa, xb = np.where(turn, b, a), np.where(turn, a, b)
        return pa.record_batch([pa.array(xa), pa.array(xb)], schema=PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = []
        for batch in batches:
            packs += [np.frombuffer(x, np.int64).reshape(-1, n) for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        if not packs:
            return
        rows = list(np.concatenate(packs, axis=1))
        packs.clear()
        by = np.lexsort((rows[1], rows[0])) if len(rows) == 2 else np.lexsort((rows[1], rows[0], rows[2], rows[0] >> 24))
        rows = [x[by] for x in rows]
        place, node = rows[:2]
        new = np.r_[True, (place[1:] != place[:-1]) | (node[1:] != node[:-1])]
        place, node, *own = [x[new] for x in rows]
        found, n = [], 0
        for i, j in bucket_pairs(place, node, own[0] if own else None, p):
            found.append((i, j))
            n += len(i)
            if n >= p.keys:
                yield out(found, node, place & 3)
                found, n = [], 0
        if n:
            yield out(found, node, place & 3)

    return run


def candidate_pairs(table: DataFrame, p: NearDupParams = NearDupParams(), sides: Column | None = None, grp: str | None = None) -> DataFrame:
    """Distinct (xa, xb) over the bags (node, els) of a table: every close pair (of different grp, if given), and some others.

    Without sides xa < xb. sides is 1, 2 or 3 per row: xa is then on side 1 and xb on side 2.
    """
    own = [F.col(grp).alias("grp")] if grp else []
    bags = table.select("node", "els", (F.lit(3) if sides is None else sides).cast("long").alias("sides"), *own)
    ranks = element_ranks(table, p)
    hot, total = bucket_sizes(bags, ranks, p)
    tasks = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // p.task_rows), min(p.least_tasks, total * 32 // p.task_rows))
    packs = bags.mapInArrow(map_side(p, ranks, tasks, hot), PACK_DDL)
    return packs.repartitionById(tasks, F.col("part")).mapInArrow(reduce_side(p), PAIR_DDL).distinct()


def _close(na: Column, nb: Column, common: Column, p: NearDupParams) -> Column:
    return common * p.den >= F.greatest(na, nb) * p.num


def verified(pairs: DataFrame, table: DataFrame, p: NearDupParams) -> DataFrame:
    """The pairs (xa, xb) of nodes whose bags are close."""
    ends = pairs.select(F.col("xa").alias("node")).unionByName(pairs.select(F.col("xb").alias("node"))).distinct()
    bags = materialize(table.select("node", "n", "els").join(ends, "node", "left_semi").dropDuplicates(["node"]), "bags")
    a = bags.select(F.col("node").alias("xa"), F.col("n").alias("na"), F.col("els").alias("ea"))
    b = bags.select(F.col("node").alias("xb"), F.col("n").alias("nb"), F.col("els").alias("eb"))
    common = F.size(F.array_intersect("ea", "eb"))
    return pairs.join(a, "xa").join(b, "xb").where(_close(F.col("na"), F.col("nb"), common, p)).select("xa", "xb")


def close_bags(table: DataFrame, p: NearDupParams = NearDupParams(), sides: Column | None = None, grp: str | None = None) -> DataFrame:
    """Verified pairs of close, different bags: (xa, xb), as candidate_pairs gives them. table: with_nodes of question_table."""
    return verified(materialize(candidate_pairs(table, p, sides, grp), "candidates"), table, p)


def star_pairs(table: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """Distinct (xa, xb), xa < xb: each text with the smallest text of each of its buckets. At most texts x bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                els = batch.column(1)
                lengths = np.diff(_np(els.offsets)).astype(np.int64)
                band = one_permutation_bands(_np(els.flatten()), lengths, p)
                node = np.repeat(_np(batch.column(0)), p.bands)
                yield pa.record_batch([pa.array(band.ravel().view(np.int64)), pa.array(node)], names=["band", "node"])

    rows = table.select("node", "els").mapInArrow(run, "band long, node long")
    lead = rows.groupBy("band").agg(F.min("node").alias("xa"), F.max("node").alias("hi")).where("xa <> hi").select("band", "xa")
    return rows.join(lead, "band").where("node <> xa").select("xa", F.col("node").alias("xb")).distinct()


def reordered_classes(table: DataFrame) -> DataFrame:
    """Pairs of unequal questions with the same bag of words, as pairs of word sequences: (node, s1, s2, os1, os2)."""
    keys = ["node", "s1", "s2", "f1", "f2"]
    mixed = materialize(table.groupBy("node").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("node"), "mixed")
    classes = table.select(*keys).join(mixed, "node", "left_semi").distinct()
    other = classes.select("node", *[F.col(c).alias(f"o{c}") for c in keys[1:]])
    same_fields = F.coalesce((F.col("f1") == F.col("of1")) & (F.col("f2") == F.col("of2")), F.lit(False))
    differ = (F.col("s1") < F.col("os1")) | ((F.col("s1") == F.col("os1")) & (F.col("s2") < F.col("os2")))
    return classes.join(other, "node").where(differ & ~same_fields).select("node", "s1", "s2", "os1", "os2").distinct()


def close_records(table: DataFrame, p: NearDupParams = NearDupParams(), first: str | None = None) -> DataFrame:
    """Pairs of records (id_a < id_b) with close questions. With first, a BOOLEAN column, the result is (t_id, e_id), a record
    where it is true and one where it is false, and other pairs are never looked for. table: from question_table.

    Every pair comes out, copies included: the result grows with the product of the copies of two close questions.
    """
    table = with_nodes(table)
    sides = None if first is None else F.when(F.col(first), F.lit(1)).otherwise(F.lit(2))
    one = table if first is None else table.where(F.col(first))
    two = table if first is None else table.where(~F.col(first))
    pairs = close_bags(table, p, sides)
    by_bag = pairs.join(one.select(F.col("node").alias("xa"), F.col("id").alias("l_id")), "xa").join(two.select(F.col("node").alias("xb"), F.col("id").alias("r_id")), "xb")
    re = materialize(reordered_classes(table), "reordered")
    if first is not None:  # either class may be on either side
        re = re.unionByName(re.select("node", F.col("os1").alias("s1"), F.col("os2").alias("s2"), F.col("s1").alias("os1"), F.col("s2").alias("os2")))
    left = one.select("node", "s1", "s2", F.col("id").alias("l_id"))
    right = two.select("node", F.col("s1").alias("os1"), F.col("s2").alias("os2"), F.col("id").alias("r_id"))
    by_order = re.join(left, ["node", "s1", "s2"]).join(right, ["node", "os1", "os2"])
    both = by_bag.select("l_id", "r_id").unionByName(by_order.select("l_id", "r_id"))
    if first is not None:
        return both.select(F.col("l_id").alias("t_id"), F.col("r_id").alias("e_id"))
    return both.select(F.least("l_id", "r_id").alias("id_a"), F.greatest("l_id", "r_id").alias("id_b"))


def class_counts(table: DataFrame) -> DataFrame:
    """(node, n_classes): the unequal questions written with each bag; questions with the same fields are equal in any order."""
    by_words = table.groupBy("node", "s1", "s2").agg(F.max(F.struct("f1", "f2")).alias("f"))
    key = [F.col("f.f1").isNotNull().alias("fielded"), F.coalesce("f.f1", "s1").alias("k1"), F.coalesce("f.f2", "s2").alias("k2")]
    return by_words.select("node", *key).distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n_classes"))


def _sets(labelled: DataFrame, *cols: str) -> DataFrame:
    """root_id (the smallest id of the label), pair_id and cols, of labels with two records or more."""
    sets = labelled.groupBy("label").agg(F.min("id").alias("root_id"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return labelled.join(sets, "label").select("root_id", F.col("id").alias("pair_id"), *cols)


def near_duplicate_classes(table: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """(root_id, pair_id) for each record in a set of records tied by equal or close questions, from record to record.

    Verified star links make classes; the prefix filter then adds every link between different classes. No pairs within
    a class are made, so a group of any size costs its star links. Records alone with their question are left out.
    """
    table = with_nodes(table)
    stars = materialize(verified(materialize(star_pairs(table, p), "stars"), table, p), "star-links")
    comp = materialize(connected_components(stars, "xa", "xb"), "star-classes")
    classed = table.join(comp, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component")
    more = close_bags(materialize(classed.select("node", "n", "els", "grp"), "classed"), p, grp="grp")
    links = materialize(stars.unionByName(more), "class-links")
    whole = connected_components(links, "xa", "xb")
    labelled = table.select("id", "node").join(whole, "node", "left").select("id", F.coalesce("component", "node").alias("label"))
    return _sets(labelled)


def near_duplicate_groups(table: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """(root_id, pair_id, n_links): near_duplicate_classes with the number of links of each record, for which all pairs of
    close bags are made.

    n_links is the number of different close texts of the record's text, other orders of its own words among them.
    """
    table = with_nodes(table)
    pairs = materialize(close_bags(table, p), "close")
    comp = connected_components(pairs, "xa", "xb")
    classes = materialize(class_counts(table), "classes")
    ends = pairs.select(F.col("xa").alias("near"), F.col("xb").alias("node")).unionByName(pairs.select(F.col("xb").alias("near"), F.col("xa").alias("node")))
    degree = ends.join(classes, "node").groupBy("near").agg(F.sum("n_classes").alias("n_near")).withColumnRenamed("near", "node")
    member = table.select("id", "node").join(comp, "node", "left").join(degree, "node", "left").join(classes, "node")
    n_links = F.coalesce("n_near", F.lit(0)) + F.col("n_classes") - 1
    return _sets(member.select(F.coalesce("component", "node").alias("label"), "id", n_links.cast("long").alias("n_links")), "n_links")
