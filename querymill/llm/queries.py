"""Queries of the training-data operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querymill.llm import p1_group_splits as splits
from querymill.llm import p2_near_duplicates as near
from querymill.llm import p3_format_duplicates as fmt
from querymill.llm import p4_category_sample as sample
from querymill.llm import p5_split_overlap as overlap
from querymill.llm import p6_packing as packing
from querymill.llm import p7_mixture as mixture
from querymill.llm import p8_subjects as subjects
from querymill.llm.questions import question_table


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return question_table(read(spark, d, "pairs"), "pair_id", "question")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.parted_sets(read(spark, d, "pairs"), read(spark, d, "split_targets"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(read(spark, d, "pairs"), read(spark, d, "split_targets"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_report(read(spark, d, "pairs"), read(spark, d, "split_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near.close_records(_questions(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near.near_duplicate_groups(_questions(spark, d))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return near.near_duplicate_classes(_questions(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return fmt.duplicates(read(spark, d, "pairs"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return fmt.collapsed(read(spark, d, "pairs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return sample.unmet(read(spark, d, "pairs"), read(spark, d, "category_targets"))


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.pairs_sample(read(spark, d, "pairs"), read(spark, d, "category_targets")).rows()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return sample.pairs_sample(read(spark, d, "pairs"), read(spark, d, "category_targets")).report_df(spark)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(read(spark, d, "pairs"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(read(spark, d, "pairs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(read(spark, d, "documents"), read(spark, d, "pack_sizes"))


def p6_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"), read(spark, d, "pack_sizes"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_report(read(spark, d, "documents"), read(spark, d, "pack_sizes"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.short_sources(read(spark, d, "documents"), read(spark, d, "source_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_sources(read(spark, d, "documents"), read(spark, d, "source_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix_report(read(spark, d, "documents"), read(spark, d, "source_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(read(spark, d, "documents"), read(spark, d, "subject_samples")).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_composition(read(spark, d, "documents"), read(spark, d, "subject_samples"), read(spark, d, "subject_areas"))


QUERIES = (
    p1_found, p1_splits, p1_report, p2_found, p2_groups, p2_classes, p3_found, p3_collapsed, p4_found, p4_sample, p4_report,
    p5_found, p5_report, p6_found, p6_packs, p6_report, p7_found, p7_mix, p7_report, p8_found, p8_composition,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


P4_FOUND = """
WITH keyed AS (
  SELECT trim(regexp_replace(lower(regexp_replace(family, '^[\\s_-]+|[\\s_-]+$', '', 'g')), '[\\s_-]+', '_', 'g')) AS family,
         CAST(style AS VARCHAR) AS style,
         trim(regexp_replace(lower(regexp_replace(source, '^[\\s_-]+|[\\s_-]+$', '', 'g')), '[\\s_-]+', '_', 'g')) AS source
  FROM pairs),
counts AS (
  SELECT 'family' AS field_name, family AS category, count(*) AS n FROM keyed GROUP BY ALL
  UNION ALL SELECT 'style', style, count(*) FROM keyed GROUP BY ALL
  UNION ALL SELECT 'source', source, count(*) FROM keyed GROUP BY ALL)
SELECT t.field_name, t.category
FROM category_targets t LEFT JOIN counts c
  ON c.field_name = t.field_name
 AND c.category = regexp_replace(lower(regexp_replace(t.category, '^[\\s_-]+|[\\s_-]+$', '', 'g')), '[\\s_-]+', '_', 'g')
WHERE coalesce(c.n, 0) < greatest(t.min_rows, round(t.target_share * ((SELECT count(*) FROM pairs) // 10), 6))
"""


WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1C), 0xFF1D, *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF5C))
NARROW = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)
P3_KEYS = f"""
WITH folded AS (SELECT pair_id, lower(translate(question, '{WIDE}', '{NARROW}')) AS f FROM pairs WHERE question IS NOT NULL),
worded AS (SELECT pair_id, f, array_to_string(regexp_extract_all(f, '[\\p{{L}}\\p{{N}}]+'), ' ') AS s FROM folded),
parts AS (
  SELECT pair_id, s, unnest([1, 2, 3, 4]) AS way, unnest([string_split(f, '|'), string_split(f, ';'),
    string_split(regexp_replace(f, '[\\n\\r]+([^:=\\n\\r]*[:=])', chr(1) || '\\1', 'g'), chr(1)), string_split_regex(f, '[|;\\n\\r]+')]) AS p FROM worded WHERE s <> ''),
worthy AS (SELECT pair_id, s, way, list_filter(p, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS p FROM parts),
fielded AS (
  SELECT pair_id, s, arg_min(array_to_string(list_sort(list_transform(p, lambda x: array_to_string(regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+'), ' '))), chr(1)), way)
    FILTER (WHERE len(p) >= 2 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '^[^:=]*[\\p{{L}}\\p{{N}}][^:=]*[:=]'))) = 0) AS g FROM worthy GROUP BY 1, 2),
grouped AS (SELECT pair_id, s, coalesce('f' || max(g) OVER (PARTITION BY s), 's' || s) AS k FROM fielded)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_KEYS + "SELECT keep_id, pair_id AS dup_id FROM (SELECT pair_id, min(pair_id) OVER (PARTITION BY k) AS keep_id FROM grouped) WHERE pair_id <> keep_id",
        "p3_collapsed": P3_KEYS + "SELECT min(pair_id) AS keep_id, count(*) AS n_copies, count(DISTINCT s) AS n_orders, FALSE AS collided FROM grouped GROUP BY k",
        "p4_found": P4_FOUND,
    }
