"""Queries of merging, extraction, publication and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph import model
from castgraph.operators import extraction, integrity, merge, publish
from castgraph.plans.views import Tables, sql_of
from castgraph.streaming import importing

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql_of(sql)
        return f

    return add


@query()
def deduplicated_credits(t: Tables) -> DataFrame:
    """How many credits each current person has before and after their fold; the fold depends on order, which SQL can't express."""
    folded = merge.deduplicate(t.people.select("rec_no", "credits", F.greatest(F.coalesce(F.size("credits"), F.lit(0)), F.lit(0)).alias("before")))
    return folded.select("rec_no", "before", F.greatest(F.coalesce(F.size("credits"), F.lit(0)), F.lit(0)).alias("after"))


@query()
def merged_people(t: Tables) -> DataFrame:
    """People after probable duplicates are merged into each other: greedy by id and folded in order, which has Python twins in the tests, no SQL."""
    merged = merge.merge_people(t.people, merge.choices(t.people, integrity.same_person_pairs(t.people)))
    return merged.select("id", F.size("credits").alias("n_credits"), F.size("aliases").alias("n_aliases"))


@query()
def upserted_credits(t: Tables) -> DataFrame:
    """Each person's own credits folded in once more: outcome sizes."""
    credit = t.people.select("id", F.posexplode("credits").alias("seq", "credit")).where("credit IS NOT NULL")
    return merge.upsert_batch(t.people.select("id", "credits"), credit).select("id", F.size("credits").alias("n_credits"))


@query()
def description_credits(t: Tables) -> DataFrame:
    return extraction.extract(t.get("documents"), "doc_id", "text", extraction.credits_of_description)


@query()
def notes_credits(t: Tables) -> DataFrame:
    return extraction.extract(t.get("documents"), "doc_id", "text", extraction.credits_of_notes)


_OTHERS = "list_filter(list_transform(list_filter(coalesce(aliases, []), lambda a: a IS NOT NULL), lambda a: a.name), lambda n: n <> canonical_name)"
_SAME = r"list_filter([links.website, links.wikipedia, CASE WHEN regexp_full_match(wikidata_qid, 'Q[0-9]+') THEN 'https://www.wikidata.org/wiki/' || wikidata_qid END], lambda u: u IS NOT NULL)"


@query(
    f"""SELECT id, replace(CAST(json_merge_patch('{{}}', json_object('@context', 'https://schema.org', '@type', 'Person', 'name', canonical_name, 'alternateName', CASE WHEN len(o) > 0 THEN list_filter(o, lambda x, i: list_position(o, x) = i) END,
    'image', image.url, 'sameAs', CASE WHEN len(s) > 0 THEN s END)) AS VARCHAR), '<', '\\u003c') AS json FROM (SELECT *, {_OTHERS} AS o, {_SAME} AS s FROM cp)"""
)
def person_linked_data(t: Tables) -> DataFrame:
    return publish.person_linked_data(t.people)


@query(
    """SELECT id, replace(CAST(json_merge_patch('{}', json_object('@context', 'https://schema.org', '@type', CASE WHEN format = 'podcast' THEN 'PodcastSeries' ELSE 'CreativeWorkSeries' END, 'name', title, 'description', description, 'image', image.url,
    'numberOfSeasons', CASE WHEN len(seasons) > 0 THEN len(seasons) END)) AS VARCHAR), '<', '\\u003c') AS json FROM cs"""
)
def show_linked_data(t: Tables) -> DataFrame:
    return publish.show_linked_data(t.shows)


_BARE = "lambda x: CASE WHEN x IS NULL THEN NULL ELSE json_merge_patch('{}', to_json(x)) END"


@query(
    f"""SELECT id, CAST(json_merge_patch('{{}}', json_object('id', id, 'canonical_name', canonical_name, 'sort_name', sort_name, 'pronouns', pronouns, 'bio', bio, 'wikidata_qid', wikidata_qid, 'links', links, 'image', image,
    'aliases', list_transform(aliases, {_BARE}), 'credits', list_transform(credits, lambda c: CASE WHEN c IS NULL THEN NULL ELSE json_merge_patch('{{}}', json_object('show', c.show, 'season', c.season, 'episode', c.episode, 'role', c.role, 'character', c.character,
    'alias', c.alias, 'year', c.year, 'note', c.note, 'sources', list_transform(c.sources, {_BARE}))) END))) AS VARCHAR) AS json FROM cp"""
)
def people_json(t: Tables) -> DataFrame:
    return publish.as_json(t.people.select(*model.PERSON.names))


@query("SELECT 'https://cast.test/shows/' || id || '/' AS url FROM cs WHERE removed_at IS NULL")
def sitemap(t: Tables) -> DataFrame:
    return publish.sitemap(t.shows, "https://cast.test/shows/", F.col("removed_at").isNotNull())


@query("SELECT DISTINCT cs.id FROM cs JOIN se ON se.show = cs.id JOIN games g ON list_contains(se.game, g.id) WHERE cs.format = 'video' AND g.edition = '5th Edition'")
def faceted_shows(t: Tables) -> DataFrame:
    return publish.faceted(publish.facet_table(t.shows, t.seasons, t.games), format="video", edition="5th Edition").select("id")


@query("SELECT id, arg_min(name, pos) AS name FROM (SELECT id, -1 AS pos, canonical_name AS name FROM cp UNION ALL SELECT person, pos, name FROM al) WHERE contains(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')), 'ron') GROUP BY id")
def search_hits(t: Tables) -> DataFrame:
    return publish.search_names(t.people, t.aliases, "Ron")


@query(
    """, w AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM documents) WHERE word IN ('lantern', 'storm', 'funeral') GROUP BY doc_id, word),
    d AS (SELECT word, count(*) AS df FROM w GROUP BY word)
    SELECT doc_id, round(sum((1 + ln(tf)) * ln(((SELECT count(*) FROM documents) + 1) / df)), 6) AS score FROM w JOIN d USING (word) GROUP BY doc_id ORDER BY sum((1 + ln(tf)) * ln(((SELECT count(*) FROM documents) + 1) / df)) DESC, doc_id LIMIT 8"""
)
def text_search(t: Tables) -> DataFrame:
    documents = t.get("documents")
    index = publish.inverted_index(documents, "doc_id", "text")
    return publish.search_text(index, "doc_id", ["lantern", "storm", "funeral"], documents.agg(F.count(F.lit(1)).alias("n_documents"))).withColumn("score", F.round("score", 6))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_events(t: Tables) -> DataFrame:
    days = importing.windowed_values(t.get("events").withColumn("ts", F.col("ts").cast("timestamp")))
    return days.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    """, e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, s"""
)
def user_sessions(t: Tables) -> DataFrame:
    return importing.sessions(t.get("events").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
