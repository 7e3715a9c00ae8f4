"""Queries of the text filters and of what is read from titles and notes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph.functions import filters, text
from castgraph.operators import audit, discovery, extraction, layouts, linking, publish
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


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BLANK = r"[\s\p{Z}\x{FEFF}]"
_trim = lambda c: f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _shape(c: str, s: filters.Shape) -> str:
    value = f"regexp_replace({_trim(c)}, {_q(s.outer)}, '', 'g')" if s.outer else _trim(c)
    always = f" AND regexp_matches({value}, {_q(s.always)})" if s.always else ""
    return f"coalesce({value} <> '' AND length({value}) BETWEEN {s.least} AND {s.most} AND len(regexp_split_to_array({value}, '\\s+')) <= {s.words} AND NOT regexp_matches({value}, {_q(s.never)}){always}, false)"


#: Lines of texts that may be names: short ones.
_LINES = "SELECT DISTINCT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) BETWEEN 1 AND 80"


def _lines(t: Tables) -> DataFrame:
    lines = t.get("documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.length("line").between(1, 80)).distinct()


@query(f"SELECT line, {', '.join(f'{_shape("line", s)} AS {k}' for k, s in filters.NAME_SHAPES.items())}, {_shape('line', filters.CHARACTER_SHAPE)} AND NOT regexp_matches({_trim('line')}, {_q(filters.ADDRESS)}) AS character, coalesce(regexp_matches({_trim('line')}, {_q(filters.JOB)}), false) AS job FROM ({_LINES})")
def name_shapes(t: Tables) -> DataFrame:
    """Which short lines of texts look like a name by each source's shape, like a character, or are a job."""
    shapes = [filters.looks_like_name("line", k).alias(k) for k in filters.NAME_SHAPES]
    return _lines(t).select("line", *shapes, filters.looks_like_character("line").alias("character"), filters.is_job("line").alias("job"))


@query(f"SELECT line, CASE {' '.join(f'WHEN regexp_matches(line, {_q(p)}) THEN {_q(k)}' for k, p in filters.CATEGORY_KINDS)} ELSE 'unknown' END AS kind, regexp_matches(line, {_q(filters.CAMPAIGN)}) AND NOT regexp_matches(line, {_q(filters.NO_CAMPAIGN)}) AS campaign FROM ({_LINES})")
def line_kinds(t: Tables) -> DataFrame:
    """What kind of entity a line's words signal, and whether it looks like a campaign's title."""
    return _lines(t).select("line", filters.entity_kind(F.array("line")).alias("kind"), filters.is_campaign("line").alias("campaign"))


_NAMES_OF = r"list_transform(regexp_split_to_array(regexp_extract(text, " + _q(filters.HOSTED) + r", 1), '(?i),|\band\b|&'), lambda n: regexp_replace(n, '^[\s\-–—]+|[\s.,;]+$', '', 'g'))"


@query(
    rf"SELECT doc_id, array_to_string((list_filter({_NAMES_OF}, lambda n: length(n) BETWEEN 2 AND 39 AND regexp_matches(n, '^\p{{L}}[\p{{L}}.''-]*(?:\s+\p{{L}}[\p{{L}}.''-]*){{0,3}}$') AND (regexp_matches(n, '^\p{{Lu}}') OR NOT contains(n, ' ')) AND NOT regexp_matches(n, '(?i)^(the|a|an|our|us|we|they|his|her|their)$')))[1:6], '|') AS hosts FROM documents WHERE text IS NOT NULL"
)
def hosts_in_texts(t: Tables) -> DataFrame:
    return t.get("documents").where("text IS NOT NULL").select("doc_id", F.array_join(filters.hosts_in_prose("text"), "|").alias("hosts"))


_image = lambda source, key: f"SELECT '{source}' AS kind, {key} AS id, image.licence AS given FROM {source} WHERE image.licence IS NOT NULL"
@query(f"SELECT kind, CAST(id AS VARCHAR) AS id, given, CASE lower(replace(given, 'CC-', 'cc ')) {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in (filters.OPEN_LICENCES | filters.FREE_LICENCES).items())} END AS licence FROM ({_image('people', 'rec_no')} UNION ALL {_image('shows', 'rec_no')} UNION ALL {_image('channels', 'id')}) WHERE given IS NOT NULL")
def image_licences(t: Tables) -> DataFrame:
    """Licences of images in our spelling; null is one not known to be free, which an image pass refuses."""
    parts = [t.get(kind).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col("image.licence").alias("given")) for kind, key in (("people", "rec_no"), ("shows", "rec_no"), ("channels", "id"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("given IS NOT NULL")
    return rows.withColumn("licence", filters.free_licence(F.replace("given", F.lit("CC-"), F.lit("cc "))))


@query(
    rf"""SELECT tconst, nconst, ordering, CASE WHEN runs THEN 'GM/DM' ELSE 'player' END AS role, CASE WHEN NOT runs AND own <> '' AND NOT regexp_matches(own, {_q(text.ROLE_LABEL)}) THEN own END AS character FROM (SELECT DISTINCT tconst, nconst, ordering, characters,
    regexp_matches(characters, {_q(filters.RUNS_THE_GAME)}) AS runs, {_trim(f"regexp_replace({_trim('characters')}, '(?i)^self\\s*[,/-]\\s*', '')")} AS own FROM title_principals WHERE characters <> '\N')"""
)
def read_characters(t: Tables) -> DataFrame:
    """Roles and characters as a catalogue's page states them."""
    rows = t.get("title_principals").where("characters <> '\\\\N'").select("tconst", "nconst", "ordering", "characters").distinct()
    return rows.select("tconst", "nconst", "ordering", filters.read_character("characters").alias("_c")).select("tconst", "nconst", "ordering", "_c.*")


def _bare(c: str, purpose: str) -> str:
    words = f"regexp_replace(replace(lower({c}), '&', ' and '), '[^a-z0-9]+', ' ', 'g')"
    generic = filters.GENERIC_WORDS[purpose]
    return f"trim(regexp_replace({f'regexp_replace({words}, {_q(generic)}, {_q(" ")}, {_q("g")})' if generic else words}, ' +', ' ', 'g'))"


_DIGITS = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in filters.NUMBER_WORDS.items()) + " ELSE w END"
_SERIES = rf"{_trim(r"regexp_replace(regexp_split_to_array(title, '(?i)\s*[-–—:]\s*(?:episode|ep\.?|part|session)\b')[1], '\s*[-–—:]\s*\d+\s*$', '')")}"


@query(f"SELECT DISTINCT title, {', '.join(f'{_bare("title", k)} AS {k}' for k in filters.GENERIC_WORDS)}, array_to_string(list_transform(string_split({_bare('title', 'season')}, ' '), lambda w: {_DIGITS}), ' ') AS numbered, {_SERIES} AS series FROM (SELECT title FROM cs UNION ALL SELECT title FROM se UNION ALL SELECT title FROM wiki_campaigns) WHERE title IS NOT NULL")
def bare_titles(t: Tables) -> DataFrame:
    """Titles in the forms they are compared in."""
    titles = t.shows.select("title").unionByName(t.seasons.select("title")).unionByName(t.get("wiki_campaigns").select("title")).where("title IS NOT NULL").distinct()
    return titles.select("title", *[filters.bare_title("title", k).alias(k) for k in filters.GENERIC_WORDS], filters.season_title("title").alias("numbered"), filters.series_of_episode("title").alias("series"))


_words = lambda c: f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f""", gk AS (SELECT key, min(name) AS name FROM (SELECT name, {_words('name')} AS key FROM games WHERE length(name) >= 6) WHERE key <> '' GROUP BY key)
    SELECT w.campaign_id, min(gk.name) AS system FROM wiki_campaigns w JOIN gk ON contains(' ' || {_words('w.system')} || ' ', ' ' || gk.key || ' ') GROUP BY w.campaign_id"""
)
def named_systems(t: Tables) -> DataFrame:
    """The first game by name that a page's system names word for word."""
    pages = t.get("wiki_campaigns").select(F.col("campaign_id").alias("id"), "system")
    return audit.first_named(pages, "system", t.games).select(F.col("show").alias("campaign_id"), F.col("name").alias("system"))


@query(
    f""", f AS (SELECT campaign_id, {_bare(_SERIES, 'feed')} AS key FROM wiki_campaigns WHERE title IS NOT NULL), s AS (SELECT id, {_bare('title', 'feed')} AS key FROM cs WHERE title IS NOT NULL)
    SELECT campaign_id, min(id) AS show FROM f JOIN s ON f.key <> '' AND s.key <> '' AND (f.key = s.key OR contains(f.key, s.key) OR contains(s.key, f.key) OR (abs(length(f.key) - length(s.key)) <= 3 AND levenshtein(f.key, s.key) <= 2)) GROUP BY campaign_id"""
)
def feed_matches(t: Tables) -> DataFrame:
    """Series of a feed (here the titles of wiki pages) and the first of our shows that has the title, contains it, or is nearly it."""
    feed = t.get("wiki_campaigns").where("title IS NOT NULL").select("campaign_id", filters.bare_title(filters.series_of_episode("title"), "feed").alias("key"))
    shows = t.shows.where("title IS NOT NULL").select("id", filters.bare_title("title", "feed").alias("key"))
    return linking.first_near(feed, "campaign_id", shows, "id").withColumnRenamed("id", "show")


@query()
def description_casts(t: Tables) -> DataFrame:
    """Casts of texts by their layout; what comes from lines in order has Python twins in the tests, no SQL."""
    return extraction.extract(t.get("documents"), "doc_id", "text", layouts.cast_of_description)


@query()
def archive_casts(t: Tables) -> DataFrame:
    return extraction.extract(t.get("documents"), "doc_id", "text", layouts.cast_of_archive)


def _key(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(strip_accents({c})), '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '^(the|a|an) ', ''))"


@query(
    f""", k AS (SELECT key, min(title) AS title, count(*) AS n FROM (SELECT title, {_key('title')} AS key FROM wiki_campaigns WHERE title IS NOT NULL) WHERE key <> '' AND key NOT IN (SELECT {_key('title')} FROM cs WHERE title IS NOT NULL) GROUP BY key),
    s AS (SELECT regexp_replace(left(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 55), '-+$', '') AS id, title, n FROM k)
    SELECT id, min(title) AS title, CAST(sum(n) AS BIGINT) AS n_pages FROM s WHERE id <> '' AND id NOT IN (SELECT id FROM cs) GROUP BY id"""
)
def discovered_shows(t: Tables) -> DataFrame:
    """Shows that wiki pages are about and we don't have."""
    return discovery.new_shows(t.get("wiki_campaigns"), t.shows)


_PLAIN = lambda c: f"trim(regexp_replace(replace(lower({c}), '&', 'and'), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f""", f AS (SELECT o.id AS show, w.title FROM (SELECT title, {_key('title')} AS key FROM wiki_campaigns WHERE title IS NOT NULL) w JOIN (SELECT id, {_key('title')} AS key FROM cs WHERE title IS NOT NULL) o ON o.key = w.key WHERE w.key <> ''),
    m AS (SELECT show, min(title) AS title FROM (SELECT show, title, {_PLAIN('title')} AS key FROM f) f WHERE key <> '' AND NOT EXISTS (SELECT 1 FROM se WHERE se.show = f.show AND {_PLAIN('se.title')} = f.key) GROUP BY show, key)
    SELECT m.show, CAST(coalesce(l.last, 0) + row_number() OVER (PARTITION BY m.show ORDER BY m.title) AS INTEGER) AS ordinal, m.title FROM m LEFT JOIN (SELECT show, max(ordinal) AS last FROM se GROUP BY show) l ON l.show = m.show"""
)
def discovered_seasons(t: Tables) -> DataFrame:
    """Pages of our shows under titles no season has, as further seasons."""
    pages = t.get("wiki_campaigns").where("title IS NOT NULL").select("title", text.title_key("title").alias("key")).where("key <> ''")
    found = pages.join(t.shows.where("title IS NOT NULL").select(F.col("id").alias("show"), text.title_key("title").alias("key")), "key").select("show", "title")
    return discovery.new_seasons(found, t.seasons)


@query(
    """SELECT id, coalesce(c.url, s.url) AS url, CASE WHEN c.url IS NOT NULL THEN 'channel' ELSE 'season' END AS found_by FROM (SELECT id FROM cs WHERE NOT coalesce(image.url IS NOT NULL, false)) b
    LEFT JOIN (SELECT x.id AS show_id, min(h.image.url) AS url FROM (SELECT id, unnest(channels) AS ch FROM cs) x JOIN channels h ON h.id = x.ch GROUP BY x.id) c ON c.show_id = b.id
    LEFT JOIN (SELECT id AS show_id, min(s.image.url) AS url FROM (SELECT id, unnest(seasons) AS s FROM cs) GROUP BY id) s ON s.show_id = b.id WHERE coalesce(c.url, s.url) IS NOT NULL"""
)
def backfilled_images(t: Tables) -> DataFrame:
    """Images for shows without one: their channels', else their seasons'."""
    of_channels = t.shows.select("id", F.explode("channels").alias("c")).join(t.channels.select(F.col("id").alias("c"), F.col("image.url").alias("url")), "c").select("id", "url")
    of_seasons = t.shows.select("id", F.explode("seasons").alias("s")).select("id", F.col("s.image.url").alias("url"))
    return discovery.with_images(t.shows, F.col("image.url").isNotNull(), [("channel", of_channels), ("season", of_seasons)])


_SPLIT = lambda c: f"regexp_split_to_array({c}, '\\s+')"


@query(
    rf""", g AS (SELECT min(host) AS creator, count(*) AS n_items, strftime(min(fetched_at), '%Y-%m-%d') AS earliest, strftime(max(fetched_at), '%Y-%m-%d') AS latest, arg_min(title, (regexp_split_to_array(lower(title), '\s+'), title)) AS low, arg_max(title, (regexp_split_to_array(lower(title), '\s+'), title)) AS high
        FROM wiki_campaigns WHERE host IS NOT NULL AND title IS NOT NULL GROUP BY lower(host) HAVING count(*) >= 3),
    w AS (SELECT *, {_SPLIT('low')} AS s, {_SPLIT('lower(low)')} AS a, {_SPLIT('lower(high)')} AS b FROM g),
    p AS (SELECT *, coalesce(list_position(list_transform(range(1, len(a) + 1), lambda i: a[i] <> coalesce(b[i], '') OR regexp_matches(a[i], '(?i)^(\d+[a-z]?|ep|episode|part|s\d|e\d)$')), true), 0) AS stop FROM w),
    c AS (SELECT *, trim(regexp_replace(array_to_string(CASE WHEN stop = 0 THEN s ELSE s[1:stop - 1] END, ' '), '[-–—:|]+$', '')) AS shared FROM p)
    SELECT creator, CASE WHEN length(shared) > 3 THEN shared ELSE creator END AS title, n_items, earliest, latest FROM c"""
)
def page_series(t: Tables) -> DataFrame:
    """Pages of one host as a series: what their titles share, their number and dates."""
    items = t.get("wiki_campaigns").select(F.col("host").alias("creator"), "title", F.date_format("fetched_at", "yyyy-MM-dd").alias("date"), F.lit(None).cast("string").alias("licence"))
    return discovery.archive_series(items).drop("licence")


@query(
    """SELECT host, campaign_id, ['GM/DM', 'player', 'host'][place] AS template FROM (SELECT host, campaign_id, place, rank() OVER (PARTITION BY host ORDER BY place) AS r FROM
    (SELECT host, campaign_id, list_min(list_filter(list_transform(list_filter(credits, lambda g: g IS NOT NULL), lambda g: list_position(['GM/DM', 'player', 'host'], g.role)), lambda p: p > 0)) AS place FROM wiki_campaigns) WHERE place IS NOT NULL) WHERE r = 1"""
)
def first_template_pages(t: Tables) -> DataFrame:
    """Of each host the pages that use the first of a ranked list of templates any of its pages uses; roles stand for templates here."""
    ranked = ["GM/DM", "player", "host"]
    ranks = F.filter(F.transform(F.filter("credits", lambda g: g.isNotNull()), lambda g: F.array_position(F.array(*map(F.lit, ranked)), g["role"])), lambda p: p > 0)
    pages = t.get("wiki_campaigns").select("host", "campaign_id", F.get(F.array(*map(F.lit, ranked)), (F.array_min(ranks) - 1).cast("int")).alias("template"))
    return discovery.first_with_hits(pages, "host", "template", ranked)


# The rules about names and titles, over the short lines of texts: the people and shows of the test data break few of them.
def _as_people(t: Tables) -> DataFrame:
    return _lines(t).select(F.col("line").alias("id"), F.col("line").alias("canonical_name"))


@query(f"SELECT DISTINCT 'high' AS severity, 'company name' AS what, n AS subject FROM (SELECT publisher AS n FROM games UNION SELECT name FROM main.channels) WHERE regexp_matches(n, {_q(audit.COMPANY_WORD)})")
def names_of_companies(t: Tables) -> DataFrame:
    names = t.games.select(F.col("publisher").alias("id")).unionByName(t.channels.select(F.col("name").alias("id"))).distinct()
    return audit.companies(names.withColumn("canonical_name", F.col("id")))


@query(f"SELECT 'high' AS severity, 'markup in a name' AS what, line AS subject FROM ({_LINES}) WHERE regexp_matches(line, {_q(audit.MARKUP)})")
def lines_with_markup(t: Tables) -> DataFrame:
    return audit.markup(_as_people(t))


@query(f"SELECT 'high' AS severity, 'instructional title' AS what, line AS subject FROM ({_LINES}) WHERE regexp_matches(line, {_q(audit.INSTRUCTIONAL)})")
def instructional_lines(t: Tables) -> DataFrame:
    return audit.instructional(_lines(t).select(F.col("line").alias("id"), F.col("line").alias("title")))


@query(f"SELECT DISTINCT 'medium' AS severity, 'title like a person' AS what, primaryName AS subject FROM name_basics WHERE regexp_matches(primaryName, {_q(audit.PERSON_SHAPED)})")
def person_shaped_names(t: Tables) -> DataFrame:
    none = F.struct(F.lit(None).cast("string").alias("podcast"), F.lit(None).cast("string").alias("youtube")).alias("links")
    names = t.get("name_basics").select(F.col("primaryName").alias("id")).distinct()
    return audit.person_shaped_titles(names.select("id", F.col("id").alias("title"), none), t.credits)


@query(
    r"""SELECT rec_no AS key, coalesce(q.id, s.id) AS id, CASE WHEN q.id IS NOT NULL THEN 'identifier' WHEN s.id IS NOT NULL THEN 'name' END AS by FROM (SELECT rec_no, wikidata_qid AS qid, regexp_replace(regexp_replace(lower(strip_accents(canonical_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM people) p
    LEFT JOIN (SELECT wikidata_qid, min(id) AS id FROM cp WHERE wikidata_qid IS NOT NULL GROUP BY wikidata_qid) q ON q.wikidata_qid = p.qid LEFT JOIN (SELECT id FROM cp UNION SELECT regexp_replace(id, '-[^-]*$', '') FROM cp) s ON s.id = p.slug"""
)
def matched_entities(t: Tables) -> DataFrame:
    """Everybody who was ever recorded, matched by identifier, else by the slug of the name, with ids also known without their last part."""
    known = t.people.select("id", "wikidata_qid").unionByName(t.people.select(F.regexp_replace("id", "-[^-]*$", "").alias("id"), F.lit(None).cast("string").alias("wikidata_qid")))
    incoming = t.get("people").select(F.col("rec_no").alias("key"), F.col("wikidata_qid").alias("qid"), F.col("canonical_name").alias("name"))
    return discovery.matched_entities(incoming, known)


_yaml = lambda c: f"""CASE WHEN regexp_matches({c}, {_q(text.YAML_UNSAFE)}) THEN '"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"' ELSE {c} END"""


@query(f"SELECT rec_no, CAST(pos AS INTEGER) AS pos, concat_ws(chr(10), '- show: ' || {_yaml('show')}, '  season: ' || CAST(season AS VARCHAR), '  role: ' || {_yaml('role')}, '  character: ' || {_yaml('character')}, '  sources:' || chr(10) || '    - url: ' || {_yaml('sources[1].url')}) AS snippet FROM cr")
def contributions(t: Tables) -> DataFrame:
    """Each credit as the text a contributor would send, with its first source."""
    first = F.get(F.filter("sources", lambda s: s.isNotNull()), F.lit(0))["url"]
    return t.credits.select("rec_no", "pos", publish.contribution(F.col("show"), F.col("season"), F.col("role"), F.col("character"), first).alias("snippet"))


@query(
    """, o AS (SELECT character, min(person) AS owner FROM cr WHERE contains(trim(character), ' ') GROUP BY character)
    SELECT DISTINCT c.person, c.part FROM (SELECT person, unnest(string_split(lower(character), ' / ')) AS part FROM cr) c JOIN o ON lower(o.character) = c.part WHERE c.person <> o.owner"""
)
def inherited_characters(t: Tables) -> DataFrame:
    """Who plays a character, or a part of one, that is the full name of one somebody else plays."""
    owners = t.credits.where(F.contains(F.trim("character"), F.lit(" "))).groupBy("character").agg(F.min("person").alias("id")).select("id", F.col("character").alias("canonical_name"))
    return audit.named_characters(t.credits.select("person", "character"), owners).select("person", "part").distinct()
