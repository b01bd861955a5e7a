"""Questions as hashed word sequences, sorted fields and bags of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.text import bag_elements, field_signature, fold, hash_pair, words_of_folded
from querymill.session import materialize, spread


def odd_sketch(els: Column, bits: int = 48) -> Column:
    """A LONG of which each bit is the parity of the elements that fall on it."""
    bit = lambda e: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(e), F.lit(bits)).cast("int"))
    return F.aggregate(els, F.lit(0).cast("long"), lambda acc, e: acc.bitwiseXOR(bit(e)))


def question_table(df: DataFrame, id_col: str, text_col: str, keep: Sequence[str] = (), bags: bool = True, check: bool = False) -> DataFrame:
    """One row per record that has a question (a text with a word), with hashes of what makes questions equal.

    Columns: id; n (words); s1, s2 (128 bits of the words in order); f1, f2 (128 bits of the sorted fields, null where the text is
    not written as fields); with check: chk, fchk, other hashes of the words and of the fields; with bags: b1, b2 (128 bits of the
    bag of words), els (the bag as LONG hashes), node (48 bits of odd sketch and 16 of b1, see p2_near_duplicates); and the
    columns of keep. Records with null text or no word are left out.

    The table is written before that filter: pushed below the projection, it would parse every text twice.
    """
    raw = spread(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), *[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__t")))
    folded = raw.withColumn("__f", fold(F.col("__t"))).drop("__t")
    parsed = folded.withColumn("__w", words_of_folded(F.col("__f")))
    seq = parsed.withColumn("__s", F.array_join("__w", " ")).withColumn("__g", field_signature(F.col("__f")))
    cols = [F.col("id"), F.size("__w").alias("n")]
    for name, source in (("s", "__s"), ("f", "__g")):
        cols += [h.alias(f"{name}{i + 1}") for i, h in enumerate(hash_pair(F.col(source)))]
    if check:
        for name, source in (("chk", "__s"), ("fchk", "__g")):
            other = F.xxhash64(F.lit("check"), F.length(source), F.reverse(F.col(source)))
            cols.append(F.when(F.col(source).isNotNull(), other).alias(name))
    if bags:
        seq = seq.withColumn("__b", F.array_join(F.sort_array("__w"), " "))
        cols += [h.alias(f"b{i + 1}") for i, h in enumerate(hash_pair(F.col("__b")))]
        seq = seq.withColumn("__e", bag_elements(F.col("__w")))
        node = F.call_function("shiftleft", odd_sketch(F.col("__e")), F.lit(16)).bitwiseOR(hash_pair(F.col("__b"))[0].bitwiseAND(F.lit(0xFFFF)))
        cols += [F.col("__e").alias("els"), node.alias("node")]
    return materialize(seq.select(*cols, *[F.col(f"`{c}`") for c in keep]), "questions").where("n > 0")
