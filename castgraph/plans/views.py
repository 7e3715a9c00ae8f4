"""Queries of the derived views (joins, inversions, provenance, aggregates, orders) with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castgraph import model
from castgraph.functions import text
from castgraph.operators import relations as rel
from castgraph.session import table

_TIERS = "['" + "','".join(model.TIERS) + "']"

#: Relations shared by the SQL of all modules: current people and shows, credits, aliases, seasons.
CTE = rf"""
WITH cp AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, rec_no DESC) AS rn FROM people WHERE id IS NOT NULL) WHERE rn = 1),
cs AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, rec_no DESC) AS rn FROM shows WHERE id IS NOT NULL) WHERE rn = 1),
cr0 AS (SELECT id AS person, rec_no, p - 1 AS pos, credits[p] AS c FROM (SELECT id, rec_no, credits, unnest(range(1, len(credits) + 1)) AS p FROM cp) WHERE credits[p] IS NOT NULL),
cr1 AS (SELECT person, rec_no, pos, c.show AS show, c.season AS season, c.episode AS episode, c.role AS role, c.character AS character, c.alias AS alias, c.year AS year, c.note AS note,
    coalesce(list_filter(c.sources, lambda s: s IS NOT NULL), []) AS sources FROM cr0),
cr AS (SELECT *, len(sources) AS n_sources,
    len(list_distinct(list_transform(sources, lambda s: CASE WHEN coalesce(s.attested_by, '') <> '' THEN 'who:' || lower(trim(s.attested_by))
        WHEN coalesce(s.url, '') <> '' THEN 'where:' || regexp_replace(lower(regexp_extract(s.url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '')
        ELSE 'note:' || lower(trim(coalesce(s.note, ''))) END))) AS n_origins,
    list_min(list_transform(sources, lambda s: coalesce(list_position({_TIERS}, coalesce(s.tier, 'reference')), 7))) AS best FROM cr1),
al AS (SELECT id AS person, rec_no, p - 1 AS pos, aliases[p].id AS alias_id, aliases[p].name AS name, aliases[p].alias_type AS alias_type
    FROM (SELECT id, rec_no, aliases, unnest(range(1, len(aliases) + 1)) AS p FROM cp) WHERE aliases[p] IS NOT NULL),
se AS (SELECT id AS show, p - 1 AS pos, s.ordinal AS ordinal, s.title AS title, s.game AS game, s.started AS started, s.ended AS ended, s.episode_count AS episode_count
    FROM (SELECT id, p, seasons[p] AS s FROM (SELECT id, seasons, unnest(range(1, len(seasons) + 1)) AS p FROM cs)) WHERE s IS NOT NULL)
"""
_STATUS = "CASE WHEN n_origins >= 2 THEN 'corroborated' ELSE 'single-source' END"


class Tables:
    """The current relations of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.get = lambda name: table(spark, folder, name)
        self.people, self.shows = rel.current(self.get("people")), rel.current(self.get("shows"))
        self.channels, self.games = self.get("channels"), self.get("games")
        self.credits, self.aliases, self.seasons = rel.credits(self.people), rel.aliases(self.people), rel.seasons(self.shows)

    def resolved(self) -> DataFrame:
        return rel.resolved_credits(self.get("people"), self.get("shows"), self.channels, self.games)


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def sql_of(sql: str) -> str:
    """The SQL after the shared relations; `show` is quoted, for it is a word of the language."""
    return re.sub(r"('(?:[^']|'')*'|\"[^\"]*\")|(?<![\w.])show(?!\w)", lambda m: m.group(1) or '"show"', CTE + sql)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL (after the shared relations)."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql_of(sql)
        return f

    return add


@query("SELECT rec_no FROM cp")
def current_people(t: Tables) -> DataFrame:
    return t.people.select("rec_no")


@query(f"SELECT rec_no, CAST(pos AS INTEGER) AS pos, CAST(n_sources AS INTEGER) AS n_sources, CAST(n_origins AS INTEGER) AS n_origins, {_STATUS} AS status, {_TIERS}[best] AS best_tier FROM cr")
def corroboration(t: Tables) -> DataFrame:
    return t.credits.select("rec_no", "pos", "n_sources", "n_origins", "status", "best_tier")


_RESOLVED = """,
chn AS (SELECT id AS show, string_agg(name, '|' ORDER BY p) AS channels FROM (SELECT cs.id, p, channels.name FROM (SELECT id, channels AS ch, unnest(range(1, len(channels) + 1)) AS p FROM cs) cs JOIN channels ON channels.id = ch[p]) GROUP BY id),
gn AS (SELECT show, ordinal, string_agg(name, '|' ORDER BY p) AS games FROM (SELECT show, ordinal, p, games.name FROM (SELECT show, ordinal, game, unnest(range(1, len(game) + 1)) AS p FROM se) s JOIN games ON games.id = game[p]) GROUP BY show, ordinal),
rc AS (SELECT cr.*, cs.title AS show_title, chn.channels, sn.title AS season_title, sn.started, gn.games, al.name AS billed
    FROM cr JOIN cs ON cs.id = cr.show LEFT JOIN chn ON chn.show = cr.show LEFT JOIN (SELECT show, ordinal, any_value(title) AS title, min(started) AS started FROM se GROUP BY show, ordinal) sn ON sn.show = cr.show AND sn.ordinal = cr.season
    LEFT JOIN gn ON gn.show = cr.show AND gn.ordinal = cr.season
    LEFT JOIN (SELECT rec_no, alias_id, arg_min(coalesce(name, ''), pos) AS name FROM al GROUP BY rec_no, alias_id) al ON al.rec_no = cr.rec_no AND al.alias_id = cr.alias)
"""


@query(_RESOLVED + f"SELECT rec_no, CAST(pos AS INTEGER) AS pos, show_title, channels, season_title, games, coalesce(billed, '') AS billed, {_STATUS} AS status FROM rc")
def resolved_credits(t: Tables) -> DataFrame:
    return t.resolved().select("rec_no", "pos", "show_title", "channels", "season_title", "games", F.coalesce("billed", F.lit("")).alias("billed"), "status")


@query(
    _RESOLVED
    + """, f AS (SELECT person, show, show_title, count(*) AS n_credits, min(coalesce(year, started)) AS earliest, max(coalesce(year, started)) AS latest,
        CAST(sum(CASE WHEN n_origins >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_corroborated, coalesce(string_agg(DISTINCT role, '|' ORDER BY role), '') AS roles FROM rc GROUP BY person, show, show_title)
    SELECT person, show, n_credits, earliest, latest, n_corroborated, roles, CASE WHEN earliest IS NULL THEN NULL WHEN left(earliest, 4) = left(latest, 4) THEN left(earliest, 4) ELSE left(earliest, 4) || '–' || left(latest, 4) END AS years,
        CAST(row_number() OVER (PARTITION BY person ORDER BY latest DESC NULLS LAST, show_title, show) AS INTEGER) AS place FROM f"""
)
def filmography(t: Tables) -> DataFrame:
    groups = rel.filmography(t.resolved())
    order = Window.partitionBy("person").orderBy(F.col("latest").desc_nulls_last(), "show_title", "show")
    return groups.withColumn("place", F.row_number().over(order)).drop("show_title")


@query("SELECT show, person, count(*) AS n_credits, min(coalesce(season, 0)) AS first_season FROM cr WHERE show IS NOT NULL GROUP BY show, person")
def show_cast(t: Tables) -> DataFrame:
    return t.credits.where("show IS NOT NULL").groupBy("show", "person").agg(F.count(F.lit(1)).alias("n_credits"), F.min(F.coalesce("season", F.lit(0))).alias("first_season"))


@query("SELECT c AS channel, count(*) AS n_shows FROM (SELECT unnest(channels) AS c FROM cs) JOIN channels ON channels.id = c GROUP BY c")
def channel_shows(t: Tables) -> DataFrame:
    shown = t.shows.select(F.explode("channels").alias("channel")).join(t.channels.select(F.col("id").alias("channel")), "channel")
    return shown.groupBy("channel").agg(F.count(F.lit(1)).alias("n_shows"))


@query("SELECT id FROM cs WHERE id NOT IN (SELECT show FROM cr WHERE show IS NOT NULL)")
def uncredited_shows(t: Tables) -> DataFrame:
    return t.shows.select("id").join(t.credits.select(F.col("show").alias("id")), "id", "left_anti")


@query("SELECT id FROM channels WHERE id NOT IN (SELECT unnest(channels) FROM cs WHERE channels IS NOT NULL)")
def channels_without_shows(t: Tables) -> DataFrame:
    return t.channels.select("id").join(t.shows.select(F.explode("channels").alias("id")), "id", "left_anti")


@query(f"SELECT coalesce({_TIERS}[best], 'none') AS tier, count(*) AS n_credits, CAST(sum(CASE WHEN n_origins >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_corroborated, count(*) - count(alias) AS n_unbilled FROM cr GROUP BY 1")
def provenance_profile(t: Tables) -> DataFrame:
    return t.credits.groupBy(F.coalesce("best_tier", F.lit("none")).alias("tier")).agg(
        F.count(F.lit(1)).alias("n_credits"), F.sum((F.col("status") == "corroborated").cast("int")).alias("n_corroborated"), F.count_if(F.col("alias").isNull()).alias("n_unbilled")
    )


_MOST = "SELECT person, count(*) AS n_credits, count(DISTINCT show) AS n_shows FROM cr GROUP BY person"


@query(f"SELECT *, CAST(row_number() OVER (ORDER BY n_credits DESC, n_shows DESC, person) AS INTEGER) AS place FROM ({_MOST}) ORDER BY place LIMIT 18")
def most_credited(t: Tables) -> DataFrame:
    counts = t.credits.groupBy("person").agg(F.count(F.lit(1)).alias("n_credits"), F.count_distinct("show").alias("n_shows"))
    top = counts.orderBy(F.desc("n_credits"), F.desc("n_shows"), "person").limit(18)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_credits"), F.desc("n_shows"), "person")))  # 18 rows


@query("SELECT show, string_agg(game, '|' ORDER BY first) AS games FROM (SELECT show, g AS game, min(pos * 1000 + p) AS first FROM (SELECT show, pos, game[p] AS g, p FROM (SELECT show, pos, game, unnest(range(1, len(game) + 1)) AS p FROM se)) WHERE g IS NOT NULL GROUP BY show, g) GROUP BY show")
def games_of_show(t: Tables) -> DataFrame:
    ids = t.seasons.select("show", "pos", F.posexplode("game").alias("p", "game")).where("game IS NOT NULL")
    first = ids.groupBy("show", "game").agg(F.min(F.struct("pos", "p")).alias("at"))
    return first.groupBy("show").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "game"))), lambda g: g["game"]), "|").alias("games"))


@query("SELECT rec_no, CAST(len(list_distinct(list_filter(list_concat([canonical_name], coalesce(list_transform(list_filter(aliases, lambda a: a IS NOT NULL), lambda a: a.name), [])), lambda n: n IS NOT NULL))) AS INTEGER) AS n_names FROM cp")
def searchable_names(t: Tables) -> DataFrame:
    names = F.array_compact(F.concat(F.array("canonical_name"), F.coalesce(F.transform("aliases", lambda a: a["name"]), F.array().cast("array<string>"))))
    return t.people.select("rec_no", F.size(F.array_distinct(names)).alias("n_names"))


@query("SELECT 'people' AS kind, count(*) AS n FROM cp UNION ALL SELECT 'shows', count(*) FROM cs UNION ALL SELECT 'channels', count(*) FROM channels UNION ALL SELECT 'games', count(*) FROM games UNION ALL SELECT 'credits', count(*) FROM cr UNION ALL SELECT 'seasons', count(*) FROM se UNION ALL SELECT 'aliases', count(*) FROM al UNION ALL SELECT 'sources', coalesce(sum(n_sources), 0) FROM cr")
def dataset_counts(t: Tables) -> DataFrame:
    parts = {"people": t.people, "shows": t.shows, "channels": t.channels, "games": t.games, "credits": t.credits, "seasons": t.seasons, "aliases": t.aliases}
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in parts.items()]
    counts.append(t.credits.agg(F.coalesce(F.sum("n_sources"), F.lit(0)).alias("n")).select(F.lit("sources").alias("kind"), "n"))
    out = counts[0]
    for part in counts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT show, coalesce(CAST(season AS VARCHAR), 'show') AS season, count(*) AS n_credits, count(DISTINCT person) AS n_people FROM cr WHERE show IS NOT NULL GROUP BY show, season")
def cast_by_season(t: Tables) -> DataFrame:
    counts = t.credits.where("show IS NOT NULL").groupBy("show", "season").agg(F.count(F.lit(1)).alias("n_credits"), F.count_distinct("person").alias("n_people"))
    return counts.withColumn("season", F.coalesce(F.col("season").cast("string"), F.lit("show")))


@query("SELECT c AS channel, count(DISTINCT person) AS n_people FROM (SELECT id, unnest(channels) AS c FROM cs) s JOIN cr ON cr.show = s.id WHERE c IS NOT NULL GROUP BY c")
def channel_cast(t: Tables) -> DataFrame:
    pairs = t.credits.select("show", "person").distinct().join(t.shows.select(F.col("id").alias("show"), F.explode("channels").alias("channel")), "show")
    return pairs.where("channel IS NOT NULL").groupBy("channel").agg(F.count_distinct("person").alias("n_people"))


@query("SELECT show, CAST(sum(coalesce(episode_count, 0)) AS BIGINT) AS n_episodes, count(*) AS n_seasons FROM se GROUP BY show")
def episodes_of_show(t: Tables) -> DataFrame:
    return t.seasons.groupBy("show").agg(F.sum(F.coalesce("episode_count", F.lit(0))).alias("n_episodes"), F.count(F.lit(1)).alias("n_seasons"))


@query("SELECT DISTINCT edition AS value, 'edition' AS facet FROM games WHERE edition IS NOT NULL UNION ALL SELECT DISTINCT format, 'format' FROM cs WHERE format IS NOT NULL")
def facet_domains(t: Tables) -> DataFrame:
    editions = t.games.where("edition IS NOT NULL").select(F.col("edition").alias("value"), F.lit("edition").alias("facet")).distinct()
    return editions.unionByName(t.shows.where("format IS NOT NULL").select(F.col("format").alias("value"), F.lit("format").alias("facet")).distinct())


@query("SELECT rec_no, CAST(coalesce(len(credits), 0) AS INTEGER) AS n_credits, CAST(coalesce(len(list_distinct(list_filter(list_transform(list_filter(credits, lambda c: c IS NOT NULL), lambda c: c.show), lambda s: s IS NOT NULL))), 0) AS INTEGER) AS n_shows FROM cp")
def people_listing(t: Tables) -> DataFrame:
    shows = F.array_distinct(F.array_compact(F.transform("credits", lambda c: c["show"])))
    return t.people.select("rec_no", F.coalesce(F.size("credits"), F.lit(0)).alias("n_credits"), F.greatest(F.coalesce(F.size(shows), F.lit(0)), F.lit(0)).alias("n_shows"))


@query("SELECT show, CAST(max(ordinal) + 1 AS INTEGER) AS next_ordinal FROM se WHERE ordinal IS NOT NULL GROUP BY show")
def next_ordinal(t: Tables) -> DataFrame:
    return t.seasons.where("ordinal IS NOT NULL").groupBy("show").agg((F.max("ordinal") + 1).cast("int").alias("next_ordinal"))


@query("SELECT id FROM cs WHERE format = 'podcast' AND list_contains(channels, (SELECT min(id) FROM channels)) = false AND coalesce(solo, false) = false")
def facet_filter(t: Tables) -> DataFrame:
    first = t.channels.agg(F.min("id").alias("_first"))
    shows = t.shows.crossJoin(F.broadcast(first))  # one row
    return shows.where((F.col("format") == "podcast") & ~F.array_contains("channels", F.col("_first")) & ~F.coalesce("solo", F.lit(False))).select("id")


@query("SELECT person, alias_id, name FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY pos) AS rn FROM al WHERE contains(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')), 'mar')) WHERE rn = 1")
def name_search(t: Tables) -> DataFrame:
    """One hit per person: the first name that contains the text."""
    hits = t.aliases.where(F.contains(text.normal_name("name"), F.lit("mar")))
    first = hits.groupBy("person").agg(F.min_by(F.struct("alias_id", "name"), "pos").alias("_hit"))
    return first.select("person", "_hit.alias_id", "_hit.name")


_ORDER = "['" + "','".join(model.CREDIT_ROLES) + "']"


@query(
    f"SELECT c.show, c.season, c.person, c.pos, CAST(row_number() OVER (PARTITION BY c.show, c.season ORDER BY coalesce(list_position({_ORDER}, c.role), 99), cp.sort_name NULLS FIRST, c.rec_no, c.pos) AS INTEGER) AS place FROM cr c JOIN cp ON cp.rec_no = c.rec_no WHERE c.season IS NOT NULL AND c.show IS NOT NULL"
)
def season_page(t: Tables) -> DataFrame:
    """The cast of each season by role, then name; roles outside the order come last."""
    position = F.array_position(F.array(*map(F.lit, model.CREDIT_ROLES)), F.col("role"))
    rows = t.credits.where("season IS NOT NULL AND show IS NOT NULL").join(t.people.select("rec_no", "sort_name"), "rec_no").withColumn("_role", F.when(F.coalesce(position, F.lit(0)) == 0, 99).otherwise(position))
    place = F.row_number().over(Window.partitionBy("show", "season").orderBy("_role", F.asc_nulls_first("sort_name"), "rec_no", "pos"))
    return rows.select("show", "season", "person", F.col("pos").cast("long").alias("pos"), place.alias("place"))


@query()
def listing_order(t: Tables) -> DataFrame:
    """Shows in the order of their sort titles under the root collation; DuckDB has no such collation."""
    return t.shows.select("id", "title", F.coalesce("sort_title", "title").alias("sort_key")).orderBy(F.collate("sort_key", "UNICODE"), "id")


@query(r"SELECT rec_no, CAST(coalesce(len(list_distinct(list_filter([links.website, links.wikipedia, links.youtube, links.podcast, links.forum, links.bluesky, links.mastodon, links.twitch], lambda u: regexp_matches(u, '(?i)^https?://')))), 0) AS INTEGER) AS n_links, CASE WHEN regexp_matches(links.website, '(?i)^https?://') THEN regexp_replace(lower(regexp_extract(links.website, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '') END AS website_host FROM cp")
def described_links(t: Tables) -> DataFrame:
    urls = F.array(*[F.col(f"links.{n}") for n in model.LINKS.names])
    http = F.array_distinct(F.filter(urls, lambda u: u.rlike("(?i)^https?://")))
    return t.people.select("rec_no", F.size(http).alias("n_links"), text.link_label(F.col("links.website"))["host"].alias("website_host"))


@query(r"SELECT rec_no, trim(regexp_replace(lower(strip_accents(canonical_name)), '[^a-z0-9]+', ' ', 'g')) AS normal_name, regexp_replace(regexp_replace(lower(strip_accents(canonical_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM cp WHERE canonical_name IS NOT NULL")
def text_forms(t: Tables) -> DataFrame:
    return t.people.where(F.col("canonical_name").isNotNull()).select("rec_no", text.normal_name("canonical_name").alias("normal_name"), text.slug("canonical_name").alias("slug"))


@query(r"SELECT id, trim(regexp_replace(regexp_replace(replace(lower(strip_accents(title)), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '^(the|a|an) ', '')) AS title_key FROM cs WHERE title IS NOT NULL")
def title_keys(t: Tables) -> DataFrame:
    return t.shows.where("title IS NOT NULL").select("id", text.title_key("title").alias("title_key"))



@query(r"SELECT host, count(*) AS n FROM (SELECT DISTINCT person, regexp_replace(lower(regexp_extract(s.url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '') AS host FROM (SELECT person, unnest(sources) AS s FROM cr)) WHERE host <> '' GROUP BY host")
def cited_hosts(t: Tables) -> DataFrame:
    hosts = t.credits.select("person", F.explode("sources").alias("s")).select("person", text.url_host("s.url").alias("host")).where("host IS NOT NULL").distinct()
    return hosts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r.rec_no, r.pos, r.role, CASE WHEN contains(role, 'GM') OR contains(role, 'DM') THEN 'gm' WHEN contains(role, 'player') THEN 'player' ELSE coalesce(role, '') END AS kind FROM (SELECT rec_no, CAST(pos AS INTEGER) AS pos, role FROM cr) r")
def role_kinds(t: Tables) -> DataFrame:
    return t.credits.select("rec_no", "pos", "role", text.role_kind("role").alias("kind"))


@query("SELECT word, count(DISTINCT id) AS n_shows FROM (SELECT id, unnest(regexp_extract_all(lower(strip_accents(title)), '[a-z0-9]+')) AS word FROM cs) GROUP BY word")
def title_index(t: Tables) -> DataFrame:
    """Inverted index of title words: how many shows have each."""
    words = t.shows.select("id", F.explode(F.array_distinct(F.split(text.normal_name("title"), " "))).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_shows"))
