"""Queries that resolve outside catalogues and wikis, rank, and take tails, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castgraph.functions import text
from castgraph.operators import catalogue, ranking
from castgraph.plans.views import Tables, sql_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql_of(sql)
        return f

    return add


def _title_key(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({c})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '^(the|a|an) ', ''))"


def _known(c: str) -> str:
    return rf"CASE WHEN {c} <> '\N' AND {c} <> '' THEN {c} END"


def _normal(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


_MATCHES = f""",
ours AS (SELECT id AS show, {_title_key('title')} AS key FROM cs WHERE title IS NOT NULL),
kept AS (SELECT DISTINCT tconst, primaryTitle, originalTitle, {_known('startYear')} AS year FROM title_basics WHERE titleType IN ({', '.join(f"'{t}'" for t in catalogue.SERIES_TYPES)})),
theirs AS (SELECT tconst, year, 0 AS place, {_title_key(_known('primaryTitle'))} AS key FROM kept UNION ALL SELECT tconst, year, 1, {_title_key(_known('originalTitle'))} FROM kept),
tm AS (SELECT show, tconst, try_cast(year AS INTEGER) AS year FROM (SELECT o.show, t.tconst, max(t.year) OVER (PARTITION BY tconst) AS year, row_number() OVER (PARTITION BY tconst ORDER BY place, o.show) AS rn FROM theirs t JOIN ours o ON o.key = t.key AND o.key <> '') WHERE rn = 1)
"""


@query(_MATCHES + "SELECT show, tconst, year FROM tm")
def title_matches(t: Tables) -> DataFrame:
    return catalogue.title_matches(t.shows, t.get("title_basics"))


def _credits(t: Tables) -> tuple[DataFrame, DataFrame]:
    matches = catalogue.title_matches(t.shows, t.get("title_basics"))
    return matches, catalogue.title_credits(matches, t.get("title_principals"), t.get("name_basics"))


_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_BLANK = r"[\s\p{Z}\x{FEFF}]"
_CREDITED = (
    _MATCHES
    + rf""", pc AS (SELECT DISTINCT tconst, nconst, try_cast(ordering AS INTEGER) AS ordering, category, list_filter(list_transform(CASE WHEN characters <> '\N' AND json_valid(characters) AND json_type(characters) = 'ARRAY' THEN from_json(characters, '["VARCHAR"]') ELSE [] END,
        lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, {_quoted(text.ROLE_LABEL)})) AS names FROM title_principals WHERE tconst IN (SELECT tconst FROM tm)),
    pr AS (SELECT *, CASE category {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in catalogue.CATEGORY_ROLES.items())} END AS kind, len(list_filter(names, lambda x: regexp_matches(x, {_quoted(catalogue.GM_CHARACTER)}))) > 0 AS runs FROM pc),
    mk AS (SELECT tconst, nconst, ordering, CASE WHEN kind = 'player' AND runs THEN 'GM/DM' ELSE kind END AS role, CASE WHEN kind = 'player' AND NOT runs AND len(names) > 0 THEN array_to_string(names, ' / ') END AS character
        FROM pr WHERE kind IS NOT NULL AND NOT (kind = 'player' AND NOT runs AND len(names) = 0 AND category = 'self')),
    cc AS (SELECT tm.show, b.tconst, b.nconst, b.role, b.character, {_known('n.primaryName')} AS name FROM (SELECT *, row_number() OVER (PARTITION BY tconst, nconst, role ORDER BY character IS NULL, ordering NULLS FIRST, character) AS rn FROM mk) b
        JOIN tm ON tm.tconst = b.tconst JOIN name_basics n ON n.nconst = b.nconst WHERE rn = 1),
    nk AS (SELECT DISTINCT person, key FROM (SELECT person, {_normal('name')} AS key FROM al UNION ALL SELECT id, {_normal('canonical_name')} FROM cp) WHERE key <> ''),
    sc AS (SELECT c.show, c.tconst, count(DISTINCT c.nconst) AS n_people, count(k.key) AS overlap, count(f.key) AS familiar FROM (SELECT DISTINCT show, tconst, nconst, {_normal('name')} AS key FROM cc) c
        LEFT JOIN (SELECT DISTINCT cr.show, nk.key FROM cr JOIN nk ON nk.person = cr.person) k ON k.show = c.show AND k.key = c.key LEFT JOIN (SELECT DISTINCT key FROM nk) f ON f.key = c.key GROUP BY c.show, c.tconst),
    vd AS (SELECT sc.*, y.year, CASE WHEN overlap > 0 THEN 'accepted' WHEN y.year < 2005 THEN 'too early' WHEN n_people > 40 THEN 'too many people' WHEN familiar < 2 THEN 'too few known' ELSE 'accepted' END AS verdict
        FROM sc LEFT JOIN (SELECT tconst, max(year) AS year FROM tm GROUP BY tconst) y ON y.tconst = sc.tconst)
    """
)


@query(_CREDITED + "SELECT show, tconst, nconst, role, character, name FROM cc")
def catalogue_credits(t: Tables) -> DataFrame:
    return _credits(t)[1]


@query(_MATCHES + "SELECT p.tconst, count(*) AS n_rows, count(DISTINCT p.nconst) AS n_people FROM title_principals p WHERE p.tconst IN (SELECT tconst FROM tm) GROUP BY p.tconst")
def candidate_principals(t: Tables) -> DataFrame:
    matches = catalogue.title_matches(t.shows, t.get("title_basics")).select("tconst").distinct()
    return t.get("title_principals").join(matches, "tconst", "left_semi").groupBy("tconst").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("nconst").alias("n_people"))


def _scored(t: Tables) -> tuple[DataFrame, DataFrame]:
    matches, credits = _credits(t)
    names = t.aliases.select("person", "name").unionByName(t.people.select(F.col("id").alias("person"), F.col("canonical_name").alias("name"))).select("person", text.normal_name("name").alias("name_key")).where("name_key <> ''").distinct()
    cast = t.credits.select("show", "person").distinct().join(names, "person").select("show", "name_key").distinct()
    return matches, catalogue.scores(matches, credits, cast, names.select("name_key"))


@query(_CREDITED + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY show ORDER BY overlap DESC, familiar DESC, tconst) AS INTEGER) AS place FROM sc) WHERE place = 1")
def best_titles(t: Tables) -> DataFrame:
    """The best title of each show by people in its cast, then by people known at all."""
    order = Window.partitionBy("show").orderBy(F.desc("overlap"), F.desc("familiar"), "tconst")
    return _scored(t)[1].withColumn("place", F.row_number().over(order)).where("place = 1")


@query(_CREDITED + "SELECT * FROM vd WHERE verdict <> 'accepted'")
def review_queue(t: Tables) -> DataFrame:
    matches, scored = _scored(t)
    return catalogue.review(scored, matches.select("tconst", "year").groupBy("tconst").agg(F.max("year").alias("year"))).where("verdict <> 'accepted'")


@query("SELECT name, arg_max(id, rec_no * 1000 + pos) AS id FROM (SELECT lower(canonical_name) AS name, id, rec_no, -1 AS pos FROM cp UNION ALL SELECT lower(name), person, rec_no, pos FROM al) WHERE name IS NOT NULL GROUP BY name")
def people_by_name(t: Tables) -> DataFrame:
    return catalogue.people_by_name(t.people, t.aliases)


@query(f"SELECT w.campaign_id, o.id AS show FROM (SELECT campaign_id, {_title_key('title')} AS key FROM wiki_campaigns WHERE title IS NOT NULL) w JOIN (SELECT id, {_title_key('title')} AS key FROM cs) o ON o.key = w.key WHERE w.key <> '' AND o.id NOT IN (SELECT show FROM cr WHERE show IS NOT NULL)")
def pages_of_uncredited_shows(t: Tables) -> DataFrame:
    """Wiki pages that have the title of a show without credits."""
    pages = t.get("wiki_campaigns").where("title IS NOT NULL").select("campaign_id", text.title_key("title").alias("key")).where("key <> ''")
    gaps = t.shows.select("id", text.title_key("title").alias("key")).join(t.credits.select(F.col("show").alias("id")), "id", "left_anti")
    return pages.join(gaps, "key").select("campaign_id", F.col("id").alias("show"))


@query("SELECT show, campaign_id, n_people FROM (SELECT o.id AS show, w.campaign_id, w.n_people, row_number() OVER (PARTITION BY o.id ORDER BY n_people DESC, campaign_id) AS rn FROM (SELECT campaign_id, " + _title_key("title") + " AS key, CAST(list_sum(list_transform(list_filter(credits, lambda g: g IS NOT NULL), lambda g: coalesce(len(g.people), 0))) AS BIGINT) AS n_people FROM wiki_campaigns WHERE title IS NOT NULL) w JOIN (SELECT id, " + _title_key("title") + " AS key FROM cs) o ON o.key = w.key WHERE w.key <> '' AND n_people >= 2) WHERE rn = 1")
def best_page_cast(t: Tables) -> DataFrame:
    """The page with most named people of each show, two at least; of equals the first."""
    size = F.aggregate(F.filter("credits", lambda g: g.isNotNull()), F.lit(0).cast("long"), lambda n, g: n + F.greatest(F.coalesce(F.size(g["people"]), F.lit(0)), F.lit(0)))
    pages = t.get("wiki_campaigns").where("title IS NOT NULL").select("campaign_id", text.title_key("title").alias("key"), size.alias("n_people")).where("key <> '' AND n_people >= 2")
    met = pages.join(t.shows.select(F.col("id").alias("show"), text.title_key("title").alias("key")), "key")
    return met.groupBy("show").agg(F.max_by(F.struct("campaign_id", "n_people"), F.struct("n_people", -F.col("campaign_id"))).alias("b")).select("show", "b.*")


@query("SELECT user_id, event_id, CAST(rn AS INTEGER) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rn <= 15 AND n >= 3")
def tail_sample(t: Tables) -> DataFrame:
    return ranking.tail(t.get("events"), "user_id", ["ts", "event_id"], 15, 3).select("user_id", "event_id", "place")


@query("SELECT user_id, round(avg(value), 4) AS mean_value, round(avg(value / greatest(1.0, coalesce(date_diff('second', ts, TIMESTAMP '2024-02-01') / 86400.0, 1.0))), 4) AS mean_per_day FROM events GROUP BY user_id")
def trending(t: Tables) -> DataFrame:
    return ranking.trending(t.get("events"), "user_id", "value", "ts", "2024-02-01 00:00:00")


@query("SELECT DISTINCT person, show, season, role, arg_min(pos, pos) OVER (PARTITION BY person, show, season, role) AS first_pos FROM cr")
def first_wins(t: Tables) -> DataFrame:
    """The first of a person's credits with the same show, season and role."""
    first = t.credits.groupBy("person", "show", "season", "role").agg(F.min("pos").cast("long").alias("first_pos"))
    return first


@query("SELECT show, best, runner_up, best - coalesce(runner_up, 0) AS gap FROM (SELECT show, max(n) FILTER (rn = 1) AS best, max(n) FILTER (rn = 2) AS runner_up FROM (SELECT show, n, row_number() OVER (PARTITION BY show ORDER BY n DESC, person) AS rn FROM (SELECT show, person, count(*) AS n FROM cr WHERE show IS NOT NULL GROUP BY show, person)) GROUP BY show)")
def runner_up_gap(t: Tables) -> DataFrame:
    counts = t.credits.where("show IS NOT NULL").groupBy("show", "person").agg(F.count(F.lit(1)).alias("n"))
    return ranking.best_and_runner_up(counts, "show", "n")


@query()
def daily_picks(t: Tables) -> DataFrame:
    return ranking.daily_picks(t.shows.select("id"), "id", 20260101, 6)


@query("SELECT a.p_name AS a, b.p_name AS b FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 2")
def fuzzy_names(t: Tables) -> DataFrame:
    return ranking.close_pairs(t.get("part").select("p_name").distinct(), "p_name", 2)


@query("SELECT b AS brand, count(DISTINCT l_orderkey) AS n_orders, min(d) AS earliest, max(d) AS latest, CASE WHEN count(DISTINCT l_suppkey) >= 2 THEN 'corroborated' ELSE 'single-source' END AS status FROM (SELECT p_brand AS b, l_orderkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS d FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY b")
def brand_history(t: Tables) -> DataFrame:
    lines = t.get("lineitem").join(t.get("part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("brand"), "l_orderkey", "l_suppkey", "l_shipdate")
    ends = lambda c, low, high: (F.min(low).alias(f"{c}_low"), F.max(high).alias(f"{c}_high"))
    orders = lines.groupBy("brand", "l_orderkey").agg(*ends("d", "l_shipdate", "l_shipdate"), *ends("s", "l_suppkey", "l_suppkey"))
    rows = orders.groupBy("brand").agg(F.count(F.lit(1)).alias("n_orders"), *ends("d", "d_low", "d_high"), *ends("s", "s_low", "s_high"))
    told = F.when(F.col("s_low") != F.col("s_high"), "corroborated").otherwise("single-source")  # two suppliers at least
    return rows.select("brand", "n_orders", F.date_format("d_low", "yyyy-MM-dd").alias("earliest"), F.date_format("d_high", "yyyy-MM-dd").alias("latest"), told.alias("status"))


_INCOMING = (
    _CREDITED
    + """, tt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY show ORDER BY overlap DESC, familiar DESC, tconst) AS rn FROM vd) WHERE rn = 1 AND verdict = 'accepted'),
    by_name AS (SELECT name, arg_max(id, rec_no * 1000 + pos) AS id FROM (SELECT lower(canonical_name) AS name, id, rec_no, -1 AS pos FROM cp UNION ALL SELECT lower(name), person, rec_no, pos FROM al) WHERE name IS NOT NULL GROUP BY name),
    ns AS (SELECT show, count(*) AS n FROM se GROUP BY show), na AS (SELECT person, count(*) AS n, min(alias_id) AS alias FROM al GROUP BY person),
    ic AS (SELECT coalesce(b.id, regexp_replace(regexp_replace(lower(strip_accents(c.name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS id, b.id IS NULL AS is_new, c.name, c.show, CASE WHEN ns.n = 1 THEN 1 END AS season, c.role, CASE WHEN lower(c.character) <> lower(c.name) THEN c.character END AS character,
        tt.overlap > 0 AS confirmed, coalesce(ns.n, 0) AS n_seasons, c.tconst FROM cc c JOIN tt ON tt.show = c.show AND tt.tconst = c.tconst LEFT JOIN by_name b ON b.name = lower(c.name) LEFT JOIN ns ON ns.show = c.show WHERE c.name IS NOT NULL)
    """
)


def _incoming(t: Tables) -> DataFrame:
    matches, credits = _credits(t)
    years = matches.select("tconst", "year").groupBy("tconst").agg(F.max("year").alias("year"))
    return catalogue.incoming(credits, catalogue.review(_scored(t)[1], years), t.seasons, catalogue.people_by_name(t.people, t.aliases))


@query(_INCOMING + "SELECT id, is_new, name, show, CAST(season AS INTEGER) AS season, role, character, confirmed, tconst FROM ic WHERE id <> ''")
def incoming_credits(t: Tables) -> DataFrame:
    """What the catalogue says of the accepted title of each show, as credits of known or new people."""
    return _incoming(t).select("id", "is_new", "name", "show", "season", "role", "character", "confirmed", "tconst")


@query(_INCOMING + "SELECT DISTINCT id, min(name) OVER (PARTITION BY id) AS canonical_name FROM ic WHERE is_new AND id <> ''")
def created_people(t: Tables) -> DataFrame:
    """People the import would create: those no name is known of."""
    return catalogue.created(_incoming(t))


@query()
def imported_people(t: Tables) -> DataFrame:
    """People after the import from the catalogue: how many credits and sources each touched one has. The fold has a Python twin in the tests, no SQL."""
    done = catalogue.import_credits(t.people, _incoming(t))
    return done.select("id", F.size("credits").alias("n_credits"), F.aggregate("credits", F.lit(0), lambda n, c: n + F.greatest(F.coalesce(F.size(c["sources"]), F.lit(0)), F.lit(0))).alias("n_sources"))


@query("SELECT DISTINCT key AS title_key, channel, CAST(n AS BIGINT) AS n FROM (SELECT key, channel, count(DISTINCT id) AS n FROM (SELECT tconst AS id, titleType AS channel, trim(regexp_replace(regexp_replace(lower(primaryTitle), '\\bseason\\s*\\d+\\b|\\bs\\d+\\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM title_basics) WHERE key <> '' AND channel IS NOT NULL GROUP BY key, channel) WHERE n >= 2")
def repeated_catalogue_titles(t: Tables) -> DataFrame:
    """Titles of the catalogue that differ at most by a season's number within one kind of title."""
    from castgraph.operators import audit

    rows = t.get("title_basics").select(F.col("tconst").alias("id"), F.col("primaryTitle").alias("title"), F.array("titleType").alias("channels"))
    return audit.same_titles(rows).withColumnRenamed("key", "title_key")
