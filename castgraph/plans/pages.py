"""Queries of the pages: one person by any name, orders, listings, trending, search, and published texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castgraph import model
from castgraph.functions import text
from castgraph.operators import publish, ranking
from castgraph.operators import relations as rel
from castgraph.plans.views import _RESOLVED, _TIERS, Tables, sql_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BASE = "https://cast.test"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql_of(sql)
        return f

    return add


def _slug(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


#: Whom the example asks for, as anybody may type it: the longest alias name of the data set, in capitals.
_ASKED = "(SELECT upper(name) FROM al WHERE name IS NOT NULL AND regexp_full_match(name, '[ -~]+') ORDER BY length(name) DESC, name LIMIT 1)"


@query(
    _RESOLVED
    + f""", q AS (SELECT {_ASKED} AS asked),
    hit AS (SELECT id FROM (SELECT id, 0 AS how FROM cp, q WHERE id = {_slug('asked')} UNION ALL SELECT id, 1 FROM cp, q WHERE lower(canonical_name) = lower(asked)
        UNION ALL SELECT person, 2 FROM al, q WHERE lower(name) = lower(asked)) ORDER BY how, id LIMIT 1)
    SELECT person, CAST(pos AS INTEGER) AS pos, show, show_title, season, role, character, games, channels, CAST(n_origins AS INTEGER) AS n_origins, CAST(row_number() OVER (ORDER BY latest DESC NULLS LAST, show_title, show, coalesce(season, 0), coalesce(episode, ''), pos) AS INTEGER) AS place
    FROM (SELECT *, max(coalesce(year, started)) OVER (PARTITION BY show) AS latest FROM rc WHERE person IN (SELECT id FROM hit))"""
)
def person_page(t: Tables) -> DataFrame:
    """The credits of the one person a name means, as the person's page orders them."""
    longest = t.aliases.where(F.col("name").rlike(r"\A[ -~]+\z")).select("name").orderBy(F.desc(F.length("name")), "name").limit(1).select(F.upper("name").alias("asked"))
    asked = [r["asked"] for r in longest.collect()]  # one name, which a user would type
    return publish.person_page(t.get("people"), t.get("shows"), t.channels, t.games, asked[0] if asked else "")


@query("SELECT show, person, pos, CAST(row_number() OVER (PARTITION BY show ORDER BY coalesce(season, 0), sort_name NULLS FIRST, rec_no, pos) AS INTEGER) AS place FROM (SELECT c.show, c.person, c.pos, c.season, c.rec_no, cp.sort_name FROM cr c JOIN cp ON cp.rec_no = c.rec_no WHERE c.show IS NOT NULL)")
def cast_order(t: Tables) -> DataFrame:
    """The cast of each show by season, those of the whole show first, then by name."""
    rows = t.credits.where("show IS NOT NULL").join(t.people.select("rec_no", "sort_name"), "rec_no")
    place = F.row_number().over(Window.partitionBy("show").orderBy(F.coalesce("season", F.lit(0)), F.asc_nulls_first("sort_name"), "rec_no", "pos"))
    return rows.select("show", "person", F.col("pos").cast("long").alias("pos"), place.alias("place"))


@query("SELECT person, show, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY coalesce(season, 0), coalesce(episode, ''), pos) AS credits FROM cr WHERE show IS NOT NULL GROUP BY person, show")
def credit_order(t: Tables) -> DataFrame:
    """The credits of a person in a show by season and episode; what has none comes first."""
    rows = t.credits.where("show IS NOT NULL").groupBy("person", "show").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("season", F.lit(0)).alias("s"), F.coalesce("episode", F.lit("")).alias("e"), "pos"))).alias("_c"))
    return rows.select("person", "show", F.array_join(F.transform("_c", lambda c: c["pos"].cast("string")), ",").alias("credits"))


@query("SELECT show, string_agg(coalesce(CAST(season AS VARCHAR), 'show'), ',' ORDER BY season NULLS LAST) AS seasons FROM (SELECT DISTINCT show, season FROM cr WHERE show IS NOT NULL) GROUP BY show")
def season_keys(t: Tables) -> DataFrame:
    """The seasons of a show that have credits in numeric order, credits without season last."""
    keys = t.credits.where("show IS NOT NULL").groupBy("show").agg(F.array_sort(F.collect_set("season")).alias("_s"), F.count_if(F.col("season").isNull()).alias("_n"))
    listed = F.concat(F.transform("_s", lambda s: s.cast("string")), F.when(F.col("_n") > 0, F.array(F.lit("show"))).otherwise(F.array().cast("array<string>")))
    return keys.select("show", F.array_join(listed, ",").alias("seasons"))


@query("SELECT id, name, n_shows, CAST(row_number() OVER (ORDER BY n_shows DESC, name NULLS FIRST, id) AS INTEGER) AS place FROM (SELECT h.id, h.name, count(s.c) AS n_shows FROM channels h LEFT JOIN (SELECT unnest(channels) AS c FROM cs) s ON s.c = h.id GROUP BY h.id, h.name)")
def channel_listing(t: Tables) -> DataFrame:
    """Channels by their number of shows, those without any included, then by name."""
    counts = t.shows.select(F.explode("channels").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    rows = t.channels.select("id", "name").join(counts, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_shows"))
    return ranking.placed(rows, [F.desc("n_shows"), F.asc_nulls_first("name"), F.asc("id")])


@query("SELECT id, n_episodes, CAST(row_number() OVER (ORDER BY n_episodes DESC, id) AS INTEGER) AS place FROM (SELECT cs.id, CAST(coalesce(sum(se.episode_count), 0) AS BIGINT) AS n_episodes FROM cs LEFT JOIN se ON se.show = cs.id WHERE cs.id NOT IN (SELECT show FROM cr WHERE show IS NOT NULL) GROUP BY cs.id) ORDER BY place LIMIT 50")
def gaps_by_episodes(t: Tables) -> DataFrame:
    """The 50 shows without credits that have most episodes."""
    bare = t.shows.select("id").join(t.credits.select(F.col("show").alias("id")), "id", "left_anti")
    episodes = F.aggregate(F.coalesce(F.transform(F.filter("seasons", lambda s: s.isNotNull()), lambda s: F.coalesce(s["episode_count"], F.lit(0)).cast("long")), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda n, e: n + e)
    rows = t.shows.select("id", episodes.alias("n_episodes")).join(bare, "id", "left_semi")
    return ranking.placed(rows.orderBy(F.desc("n_episodes"), "id").limit(50), [F.desc("n_episodes"), F.asc("id")])


@query("SELECT id, n_people, CAST(row_number() OVER (ORDER BY n_people, id) AS INTEGER) AS place FROM (SELECT cs.id, count(DISTINCT cr.person) AS n_people FROM cs JOIN cr ON cr.show = cs.id WHERE cs.links.website IS NOT NULL GROUP BY cs.id) ORDER BY place LIMIT 40")
def import_targets(t: Tables) -> DataFrame:
    """The 40 shows with a website whose cast is smallest."""
    cast = t.credits.where("show IS NOT NULL").groupBy(F.col("show").alias("id")).agg(F.count_distinct("person").alias("n_people"))
    rows = t.shows.where("links.website IS NOT NULL").select("id").join(cast, "id").orderBy("n_people", "id").limit(40)
    return ranking.placed(rows, [F.asc("n_people"), F.asc("id")])


@query(
    """, g AS (SELECT cs.id, any_value(cs.title) AS title, any_value(cs.channels) AS channels, coalesce(sum(se.episode_count), 0) AS n FROM cs LEFT JOIN se ON se.show = cs.id WHERE cs.id NOT IN (SELECT show FROM cr WHERE show IS NOT NULL) GROUP BY cs.id)
    SELECT name, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT title AS name, n FROM g UNION ALL SELECT h.name, n FROM (SELECT n, unnest(channels) AS c FROM g) x JOIN channels h ON h.id = x.c) WHERE name IS NOT NULL GROUP BY name"""
)
def probe_names(t: Tables) -> DataFrame:
    """Titles and channel names of shows without credits, weighted by their episodes."""
    gaps = t.shows.join(t.credits.select(F.col("show").alias("id")), "id", "left_anti").select("id", "title", "channels")
    weights = t.seasons.groupBy(F.col("show").alias("id")).agg(F.sum(F.coalesce("episode_count", F.lit(0))).alias("n"))
    told = gaps.join(weights, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    channels = told.select("n", F.explode("channels").alias("c")).join(t.channels.select(F.col("id").alias("c"), "name"), "c").select("name", "n")
    return told.select(F.col("title").alias("name"), "n").unionByName(channels).where("name IS NOT NULL").groupBy("name").agg(F.sum("n").alias("weight"))


@query(f"SELECT rec_no, CAST(pos AS INTEGER) AS pos, coalesce({_TIERS}[best], 'none') AS tier, CAST(CASE WHEN best <= 6 THEN best END AS INTEGER) AS tier_rank, CASE WHEN best <= 3 THEN 'strong' WHEN best <= 6 THEN 'medium' END AS strength FROM cr")
def tier_info(t: Tables) -> DataFrame:
    """Rank and strength of each credit's best tier: the first three are strong, the others medium."""
    rank = F.array_position(F.array(*map(F.lit, model.TIERS)), F.col("best_tier")).cast("int")
    return t.credits.select("rec_no", "pos", F.coalesce("best_tier", F.lit("none")).alias("tier"), rank.alias("tier_rank"), F.when(rank <= 3, "strong").when(rank > 3, "medium").alias("strength"))


@query("SELECT h.id AS channel, coalesce(p.n, 0) AS n_people, coalesce(s.n, 0) AS n_seasons FROM channels h LEFT JOIN (SELECT c, count(DISTINCT person) AS n FROM (SELECT id, unnest(channels) AS c FROM cs) x JOIN cr ON cr.show = x.id GROUP BY c) p ON p.c = h.id LEFT JOIN (SELECT c, count(*) AS n FROM (SELECT id, unnest(channels) AS c FROM cs) x JOIN se ON se.show = x.id GROUP BY c) s ON s.c = h.id")
def channel_page(t: Tables) -> DataFrame:
    """People and seasons of each channel's shows."""
    of = t.shows.select(F.col("id").alias("show"), F.explode("channels").alias("channel"))
    people = t.credits.select("show", "person").distinct().join(of, "show").groupBy("channel").agg(F.count_distinct("person").alias("n_people"))
    seasons = t.seasons.groupBy("show").agg(F.count(F.lit(1)).alias("n")).join(of, "show").groupBy("channel").agg(F.sum("n").alias("n_seasons"))
    rows = t.channels.select(F.col("id").alias("channel")).join(people, "channel", "left").join(seasons, "channel", "left")
    return rows.select("channel", F.coalesce("n_people", F.lit(0)).alias("n_people"), F.coalesce("n_seasons", F.lit(0)).alias("n_seasons"))


@query("SELECT rec_no, array_to_string(list_filter(list_transform(list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL), lambda a: a.name), lambda n: n IS NOT NULL AND n IS DISTINCT FROM canonical_name), '|') AS other_names FROM cp")
def other_names(t: Tables) -> DataFrame:
    names = F.filter(F.transform(F.filter("aliases", lambda a: a.isNotNull()), lambda a: a["name"]), lambda n: n.isNotNull() & ~n.eqNullSafe(F.col("canonical_name")))
    return t.people.select("rec_no", F.array_join(F.coalesce(names, F.array().cast("array<string>")), "|").alias("other_names"))


_VIDEOS = """, v AS (SELECT show_id, doc_id, n_chars, published_at FROM documents WHERE show_id IS NOT NULL),
    last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY show_id ORDER BY doc_id DESC) AS rn, count(*) OVER (PARTITION BY show_id) AS n FROM v) WHERE rn <= 15 AND n >= 3),
    rate AS (SELECT show_id, avg(coalesce(n_chars, 0)) AS mean_value, avg(coalesce(n_chars, 0) / greatest(1.0, coalesce(date_diff('second', published_at, TIMESTAMP '2026-01-01') / 86400.0, 1.0))) AS mean_per_day FROM last GROUP BY show_id)"""


@query(_VIDEOS + """ SELECT show, title, season, season_title, mean_value, mean_per_day, CAST(row_number() OVER (ORDER BY mean_per_day DESC, show) AS INTEGER) AS place FROM (
    SELECT cs.id AS show, cs.title, s.ordinal AS season, s.title AS season_title, round(r.mean_value, 4) AS mean_value, round(r.mean_per_day, 4) AS mean_per_day FROM rate r JOIN cs ON cs.id = r.show_id
    LEFT JOIN (SELECT show, ordinal, any_value(title) AS title FROM se WHERE ordinal = 1 GROUP BY show, ordinal) s ON s.show = cs.id) ORDER BY place LIMIT 24""")
def trending_shows(t: Tables) -> DataFrame:
    """The 24 shows whose last texts have most characters a day, with their first season if they have one; rows of unknown shows drop out.

    Characters stand for views: the test data has no view counts.
    """
    videos = t.get("documents").where("show_id IS NOT NULL").select("show_id", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"), "published_at")
    rates = ranking.trending(ranking.tail(videos, "show_id", ["doc_id"], 15, 3), "show_id", "n_chars", "published_at", "2026-01-01 00:00:00")
    return ranking.live_trending(rates.withColumn("season", F.lit(1)), t.shows, t.seasons, 24)


@query("SELECT kind, id, name FROM (SELECT 'person' AS kind, id, arg_min(name, pos) AS name FROM (SELECT id, -1 AS pos, canonical_name AS name FROM cp UNION ALL SELECT person, pos, name FROM al) WHERE contains(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')), 'lan') GROUP BY id UNION ALL SELECT 'show', id, title FROM cs WHERE contains(trim(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', ' ', 'g')), 'lan'))")
def site_search(t: Tables) -> DataFrame:
    """People by any name, one hit each, and shows by their titles."""
    people = publish.search_names(t.people, t.aliases, "Lan").select(F.lit("person").alias("kind"), "id", "name")
    shows = t.shows.where(F.contains(text.normal_name("title"), F.lit("lan"))).select(F.lit("show").alias("kind"), "id", F.col("title").alias("name"))
    return people.unionByName(shows)


@query("SELECT DISTINCT ON (name) name, source FROM (SELECT canonical_name AS name, 'canonical' AS source, 0 AS place FROM cp UNION ALL SELECT name, 'alias', 1 FROM al UNION ALL SELECT primaryName, 'catalogue', 2 FROM name_basics) WHERE name IS NOT NULL ORDER BY name, place")
def names_by_source(t: Tables) -> DataFrame:
    """All names once, each with the first of its sources: canonical names, aliases, the catalogue."""
    parts = [t.people.select(F.col("canonical_name").alias("name"), F.lit(0).alias("place"), F.lit("canonical").alias("source")), t.aliases.select("name", F.lit(1).alias("place"), F.lit("alias").alias("source")), t.get("name_basics").select(F.col("primaryName").alias("name"), F.lit(2).alias("place"), F.lit("catalogue").alias("source"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("name IS NOT NULL")
    return rows.groupBy("name").agg(F.min_by("source", "place").alias("source"))


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_LINK_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(u, {_quoted(p)}) THEN {_quoted(kind + ':' + label)}" for p, label, kind in text.LINK_LABELS) + f" ELSE {_quoted(text.OTHER_LINK[1] + ':' + text.OTHER_LINK[0])} END"


@query(
    f""", u AS (SELECT rec_no, min(spot) AS spot, u FROM (SELECT rec_no, unnest(range(1, 9)) AS spot, unnest([{', '.join(f'links.{n}' for n in model.LINKS.names)}]) AS u FROM cp) WHERE regexp_matches(u, '(?i)^https?://[^/?#\\s]') GROUP BY rec_no, u),
    d AS (SELECT *, {_LINK_KINDS} AS what FROM u), o AS (SELECT *, list_position(['watch', 'listen', 'home', 'read'], regexp_extract(what, '^[a-z]+')) AS ord FROM d)
    SELECT cp.rec_no, coalesce(string_agg(what, '|' ORDER BY ord, spot), '') AS links, arg_min(u, ord * 100 + spot) AS primary_link FROM cp LEFT JOIN o ON o.rec_no = cp.rec_no GROUP BY cp.rec_no"""
)
def primary_links(t: Tables) -> DataFrame:
    """The links of each person described and in order of their kinds (watch, listen, home, read), and the first of them."""
    urls = F.array(*[F.col(f"links.{n}") for n in model.LINKS.names])
    return t.people.select("rec_no", publish.described(urls).alias("_l")).select("rec_no", F.array_join(F.transform("_l", lambda x: F.concat(x["kind"], F.lit(":"), x["label"])), "|").alias("links"), F.get("_l", F.lit(0))["url"].alias("primary_link"))


def _json(fields: dict[str, str], source: str) -> str:
    body = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return f"SELECT id, CAST(json_merge_patch('{{}}', json_object({body})) AS VARCHAR) AS json FROM {source}"


@query(_json({"id": "id", "name": "name", "edition": "edition", "publisher": "publisher", "gm_less": "gm_less"}, "games"))
def games_json(t: Tables) -> DataFrame:
    return publish.as_json(t.games.select("id", "name", "edition", "publisher", "gm_less"))


@query(_json({"id": "id", "name": "name", "type": "type", "description": "description"}, "channels"))
def channels_json(t: Tables) -> DataFrame:
    return publish.as_json(t.channels.select("id", "name", "type", "description"))


@query(_json({"id": "id", "title": "title", "sort_title": "sort_title", "channels": "channels", "format": "format", "solo": "solo", "status": "status", "description": "description"}, "cs"))
def shows_json(t: Tables) -> DataFrame:
    return publish.as_json(t.shows.select("id", "title", "sort_title", "channels", "format", "solo", "status", "description"))


@query(_json({"@context": "'https://schema.org'", "@type": "'Organization'", "name": "name", "description": "description", "url": "links.website"}, "channels"))
def channel_linked_data(t: Tables) -> DataFrame:
    return publish.channel_linked_data(t.channels)


@query(
    """SELECT show, ordinal, CAST(json_merge_patch('{}', json_object('@context', 'https://schema.org', '@type', 'CreativeWorkSeason', 'name', title, 'seasonNumber', ordinal, 'numberOfEpisodes', episode_count, 'startDate', started, 'endDate', ended,
    'partOfSeries', json_merge_patch('{}', json_object('@type', 'CreativeWorkSeries', 'name', (SELECT any_value(cs.title) FROM cs WHERE cs.id = se.show))))) AS VARCHAR) AS json FROM se"""
)
def season_linked_data(t: Tables) -> DataFrame:
    return publish.season_linked_data(t.shows, t.seasons)


@query(f"SELECT '{BASE}/api/' || kind || '.json' AS endpoint, kind, n FROM (SELECT 'people' AS kind, count(*) AS n FROM cp UNION ALL SELECT 'shows', count(*) FROM cs UNION ALL SELECT 'channels', count(*) FROM channels UNION ALL SELECT 'games', count(*) FROM games)")
def manifest_rows(t: Tables) -> DataFrame:
    """What the manifest says of each collection."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in (("people", t.people), ("shows", t.shows), ("channels", t.channels), ("games", t.games))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return rows.withColumn("endpoint", F.concat(F.lit(f"{BASE}/api/"), "kind", F.lit(".json")))


@query(
    f"""SELECT '# Cast' || chr(10) || chr(10) || 'People: ' || (SELECT count(*) FROM cp) || chr(10) || 'Shows: ' || (SELECT count(*) FROM cs) || chr(10) || 'Credits: ' || (SELECT count(*) FROM cr) || chr(10) || 'Corroborated: ' || (SELECT count(*) FROM cr WHERE n_origins >= 2)
    || chr(10) || chr(10) || '{BASE}/api/index.json' || chr(10) AS body"""
)
def front_text(t: Tables) -> DataFrame:
    """The text front door with live counts: one row."""
    return publish.front_text(t.people, t.shows, t.credits, BASE)


@query("SELECT severity, what, subject, CAST(row_number() OVER (ORDER BY list_position(['high','medium','low'], severity), what, subject) AS INTEGER) AS place FROM (SELECT 'medium' AS severity, 'one credit in a season' AS what, show || ':' || CAST(season AS VARCHAR) AS subject FROM cr WHERE season IS NOT NULL AND show IS NOT NULL GROUP BY show, season HAVING count(*) = 1 UNION ALL SELECT 'low', 'no title', id FROM cs WHERE title IS NULL) ORDER BY place LIMIT 60")
def first_findings(t: Tables) -> DataFrame:
    """The 60 findings a console shows: the most severe first."""
    from castgraph.operators import audit

    untitled = t.shows.where("title IS NULL").select(F.lit("low").alias("severity"), F.lit("no title").alias("what"), F.col("id").alias("subject"))
    return audit.console(audit.lone_credits(t.credits).unionByName(untitled), 60)


@query("SELECT word, count(*) AS n_people FROM (SELECT DISTINCT id, unnest(regexp_extract_all(lower(strip_accents(canonical_name)), '[a-z0-9]+')) AS word FROM cp) GROUP BY word ORDER BY n_people DESC, word LIMIT 30")
def common_name_words(t: Tables) -> DataFrame:
    words = t.people.select("id", F.explode(F.array_distinct(F.split(text.normal_name("canonical_name"), " "))).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n_people")).orderBy(F.desc("n_people"), "word").limit(30)


@query()
def weighted_random_entity(t: Tables) -> DataFrame:
    """One entity picked at random, collections weighted by their size; a seeded draw that SQL does not share."""
    parts = [df.select(F.lit(kind).alias("kind"), "id") for kind, df in (("people", t.people), ("shows", t.shows), ("channels", t.channels), ("games", t.games))]
    return ranking.random_entity(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), 7)


@query(r"SELECT host, person, n, CAST(row_number() OVER (PARTITION BY person ORDER BY n DESC, host) AS INTEGER) AS place FROM (SELECT person, host, count(*) AS n FROM (SELECT person, regexp_replace(lower(regexp_extract(s.url, '^[a-zA-Z]+://([^/?#]+)', 1)), '^www\.', '') AS host FROM (SELECT person, unnest(sources) AS s FROM cr)) WHERE host IN (SELECT host FROM wiki_campaigns) GROUP BY person, host)")
def wikis_of_person(t: Tables) -> DataFrame:
    """The wikis each person's credits cite, the most cited first."""
    hosts = t.credits.select("person", F.explode("sources").alias("s")).select("person", text.url_host("s.url").alias("host"))
    wikis = t.get("wiki_campaigns").select("host").distinct()
    counts = hosts.join(wikis, "host", "left_semi").groupBy("person", "host").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("n"), "host")))
