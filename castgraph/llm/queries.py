"""Queries of the problems whose operators live in this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castgraph.llm import bpe, leaks, matching, names, pieces, reflist, survivorship, textnorm
from castgraph.session import table


def _lists(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("wiki_campaigns", "games", "credit_fields")] + [reflist.field_aliases(spark)]


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    return reflist.map_campaigns(*_lists(spark, folder))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mapped(spark, folder).drop("value")


def p1_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry within distance of each distinct value."""
    return reflist.entries_within(*_lists(spark, folder))


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values without an entry, with their numbers of rows."""
    return reflist.unmatched_report(_mapped(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.person_links(table(spark, folder, "people"), table(spark, folder, "wiki_campaigns"), table(spark, folder, "shows"))


def _survivors(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "people")
    groups = names.same_people(people, table(spark, folder, "wiki_campaigns"), table(spark, folder, "shows"))
    return survivorship.best_representatives(people, groups)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _survivors(spark, folder).select("group_id", "name_rec", "qid_rec", "image_rec")


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving record of each person, with its values."""
    return _survivors(spark, folder).select("group_id", "name", "qid", F.col("image.url").alias("image_url"))


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    return matching.match_programmes(*[table(spark, folder, t) for t in ("shows", "people", "title_basics", "title_principals", "name_basics")])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return matching.matches(_matched(spark, folder)).select("show_id", "tconst")


def p4_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate pair with its evidence and marginal probability."""
    return _matched(spark, folder).withColumn("confidence", F.round("confidence", 4)).withColumn("log_odds", F.round("log_odds", 4))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return textnorm.canonical_names(table(spark, folder, "people")).where("is_case").select("rec_no", "pos")


def p6_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every name in its consistent form."""
    return textnorm.canonical_names(table(spark, folder, "people")).select("rec_no", "pos", "consistent")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_column(table(spark, folder, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where(F.col("n_words") >= leaks.MIN_WORDS).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Also passages with a typing error, with the longest exact run and the distance."""
    return _leaks(spark, folder)


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split_oversized(table(spark, folder, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_pieces(spark, folder).where(F.col("piece_no") == 0).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_entries, p1_unmatched, p2_found, p3_found, p3_survivors, p4_found, p4_confidence, p6_found, p6_names, p8_ids, p9_found, p9_leaks, p10_found, p10_pieces)}

ORACLE = {
    "p9_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS p FROM d)),
        ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS p FROM i))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
