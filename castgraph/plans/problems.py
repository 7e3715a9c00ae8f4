"""Queries of the problems that are solved in the core: orphan references and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castgraph import model
from castgraph.operators import flatten, orphans
from castgraph.session import table


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = orphans.orphan_references(table(spark, folder, "people"), table(spark, folder, "shows"), table(spark, folder, "games"))
    return found.drop("loaded_at")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, field, status and month."""
    return orphans.orphan_counts(table(spark, folder, "people"), table(spark, folder, "shows"), table(spark, folder, "games"))


def _elements(spark: SparkSession, folder: str) -> DataFrame:
    return flatten.nested_elements(table(spark, folder, "people"), table(spark, folder, "shows"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _elements(spark, folder).drop("value")


def p7_credits(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of credits."""
    return flatten.flat_table(_elements(spark, folder), "credit", model.CREDIT_FLAT).drop("subpos")


def p7_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of sources, linked to credits by (rec_no, pos)."""
    return flatten.flat_table(_elements(spark, folder), "source", model.SOURCE).withColumnsRenamed({"pos": "credit_pos", "subpos": "pos"})


def p7_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of aliases."""
    return flatten.flat_table(_elements(spark, folder), "alias", model.ALIAS).drop("subpos")


def p7_seasons(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of seasons; the list of games stays a joined string."""
    seasons = flatten.flat_table(_elements(spark, folder), "season", model.SEASON)
    return seasons.select("rec_no", "pos", "ordinal", "title", "started", "ended", "episode_count", F.array_join("game", "|", "").alias("games"))


QUERIES = {f.__name__: f for f in (p5_found, p5_counts, p7_found, p7_credits, p7_sources, p7_aliases, p7_seasons)}

_P5 = """
WITH t AS (SELECT id, min(loaded_at) AS first_at, min(removed_at) AS removed_at FROM shows WHERE id IS NOT NULL GROUP BY id),
ords AS (SELECT DISTINCT id, s.ordinal AS ordinal FROM (SELECT id, unnest(seasons) AS s FROM shows) WHERE s IS NOT NULL AND s.ordinal IS NOT NULL),
c AS (
  SELECT rec_no, loaded_at, aliases, pos - 1 AS pos, credits[pos] AS c
  FROM (SELECT rec_no, loaded_at, aliases, credits, unnest(range(1, len(credits) + 1)) AS pos FROM people)
  WHERE credits[pos] IS NOT NULL),
shown AS (
  SELECT 'people' AS src, c.rec_no, c.pos, 'show' AS field, c.c.show AS ref,
    CASE WHEN t.id IS NULL THEN 'missing' WHEN t.removed_at <= c.loaded_at THEN 'removed' WHEN t.first_at > c.loaded_at THEN 'late' END AS status, c.loaded_at
  FROM c LEFT JOIN t ON t.id = c.c.show WHERE c.c.show IS NOT NULL),
seasoned AS (
  SELECT 'people' AS src, c.rec_no, c.pos, 'season' AS field, CAST(c.c.season AS VARCHAR) AS ref, 'missing' AS status, c.loaded_at
  FROM c JOIN t ON t.id = c.c.show LEFT JOIN ords o ON o.id = c.c.show AND o.ordinal = c.c.season
  WHERE c.c.season IS NOT NULL AND o.id IS NULL),
aliased AS (
  SELECT 'people' AS src, rec_no, pos, 'alias' AS field, c.alias AS ref, 'missing' AS status, loaded_at
  FROM c WHERE c.alias IS NOT NULL AND NOT coalesce(list_contains(list_transform(aliases, lambda a: a.id), c.alias), false)),
gamed AS (
  SELECT DISTINCT 'shows' AS src, rec_no, pos, 'game' AS field, ref, 'missing' AS status, loaded_at
  FROM (SELECT rec_no, loaded_at, pos - 1 AS pos, unnest(seasons[pos].game) AS ref
        FROM (SELECT rec_no, loaded_at, seasons, unnest(range(1, len(seasons) + 1)) AS pos FROM shows))
  WHERE ref IS NOT NULL AND ref NOT IN (SELECT id FROM games WHERE id IS NOT NULL)),
found AS (SELECT * FROM shown WHERE status IS NOT NULL UNION ALL SELECT * FROM seasoned UNION ALL SELECT * FROM aliased UNION ALL SELECT * FROM gamed)
"""

_CREDITS = "SELECT rec_no, pos - 1 AS pos, credits[pos] AS c FROM (SELECT rec_no, credits, unnest(range(1, len(credits) + 1)) AS pos FROM people) WHERE credits[pos] IS NOT NULL"
_ALIASES = "SELECT rec_no, pos - 1 AS pos, aliases[pos] AS a FROM (SELECT rec_no, aliases, unnest(range(1, len(aliases) + 1)) AS pos FROM people) WHERE aliases[pos] IS NOT NULL"
_SEASONS = "SELECT rec_no, pos - 1 AS pos, seasons[pos] AS s FROM (SELECT rec_no, seasons, unnest(range(1, len(seasons) + 1)) AS pos FROM shows) WHERE seasons[pos] IS NOT NULL"
_SOURCES = f"SELECT rec_no, credit_pos, pos - 1 AS pos, c.sources[pos] AS s FROM (SELECT rec_no, pos AS credit_pos, c, unnest(range(1, len(c.sources) + 1)) AS pos FROM ({_CREDITS})) WHERE c.sources[pos] IS NOT NULL"

ORACLE = {
    "p5_found": _P5 + "SELECT src, rec_no, CAST(pos AS INTEGER) AS pos, field, ref, status FROM found",
    "p5_counts": _P5 + "SELECT src, field, status, strftime(loaded_at, '%Y-%m') AS period, count(*) AS n_refs, count(DISTINCT ref) AS n_keys FROM found GROUP BY ALL",
    "p7_found": f"""
        SELECT 'people' AS src, rec_no, 'alias' AS child, CAST(pos AS INTEGER) AS pos, CAST(-1 AS INTEGER) AS subpos FROM ({_ALIASES})
        UNION ALL SELECT 'people', rec_no, 'credit', CAST(pos AS INTEGER), -1 FROM ({_CREDITS})
        UNION ALL SELECT 'people', rec_no, 'source', CAST(credit_pos AS INTEGER), CAST(pos AS INTEGER) FROM ({_SOURCES})
        UNION ALL SELECT 'shows', rec_no, 'season', CAST(pos AS INTEGER), -1 FROM ({_SEASONS})""",
    "p7_credits": f"SELECT rec_no, CAST(pos AS INTEGER) AS pos, c.show, c.season, c.episode, c.role, c.character, c.alias, c.year, c.note FROM ({_CREDITS})",
    "p7_sources": f"SELECT rec_no, CAST(credit_pos AS INTEGER) AS credit_pos, CAST(pos AS INTEGER) AS pos, s.url, s.note, s.tier, s.attested_by, s.locator FROM ({_SOURCES})",
    "p7_aliases": f"SELECT rec_no, CAST(pos AS INTEGER) AS pos, a.id, a.name, a.alias_type, a.active_from, a.active_to, a.note FROM ({_ALIASES})",
    "p7_seasons": f"SELECT rec_no, CAST(pos AS INTEGER) AS pos, s.ordinal, s.title, s.started, s.ended, s.episode_count, CASE WHEN s.game IS NULL THEN NULL ELSE array_to_string(list_transform(s.game, lambda g: coalesce(g, '')), '|') END AS games FROM ({_SEASONS})",
}
