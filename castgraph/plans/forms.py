"""Queries of the text functions and of payload sources, with their SQL: payloads are built from tables and must come back as they went in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph.functions import text
from castgraph.plans.views import Tables, sql_of
from castgraph.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql_of(sql)
        return f

    return add


_BLANK = r"[\s\p{Z}\x{FEFF}]"
_trim = lambda c: f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_plain = lambda c: f"lower(strip_accents({c}))"
_key = lambda c: f"trim(regexp_replace(regexp_replace(replace({_plain(c)}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'), '^(the|a|an) ', ''))"
_slug = lambda c: f"regexp_replace(regexp_replace({c}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(rf"SELECT campaign_id, {_trim('title')} AS title, {_trim('page')} AS notes, url AS link FROM wiki_campaigns WHERE NOT regexp_matches(title || page || url, '[<>&]|\s\s|\n') AND url IS NOT NULL AND {_trim('title')} <> '' AND {_trim('page')} <> ''")
def feed_episodes(t: Tables) -> DataFrame:
    """Pages written as items of a feed and read back."""
    pages = t.get("wiki_campaigns").where(~F.concat("title", "page", "url").rlike(r"[<>&]|\s\s|\n") & (text.trim("title") != "") & (text.trim("page") != ""))
    item = F.concat(F.lit("<rss><channel><item><title>"), "title", F.lit("</title><description>no</description><content:encoded><![CDATA[<p>"), "page", F.lit("</p>]]></content:encoded><link>"), "url", F.lit("</link><guid>"), F.col("campaign_id").cast("string"), F.lit("</guid></item></channel></rss>"))
    found = files.feed_items(pages.select(item.alias("xml")), keep=["guid"])
    return found.select(F.col("guid").cast("long").alias("campaign_id"), text.trim("title").alias("title"), "notes", "link")


@query("SELECT CAST(doc_id AS VARCHAR) AS identifier, kind AS title, source AS creator, lower(lang) AS subjects FROM documents WHERE kind IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
def archive_rows(t: Tables) -> DataFrame:
    """Documents written as items of an archive's search, some fields as lists, and read back."""
    rows = t.get("documents").where("kind IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    payload = F.to_json(F.struct(F.col("doc_id").cast("string").alias("identifier"), F.array("kind", F.lit("other")).alias("title"), F.col("source").alias("creator"), F.array("lang").alias("subject")))
    return files.archive_items(rows.select(payload.alias("json"))).select("identifier", "title", "creator", F.array_join("subjects", "|").alias("subjects"))


@query("SELECT nconst AS id, n AS name, k AS kind FROM (SELECT nconst, unnest([primaryName, upper(primaryName)]) AS n, unnest(['label', 'alias']) AS k FROM name_basics WHERE primaryName IS NOT NULL AND primaryName <> upper(primaryName))")
def entity_names(t: Tables) -> DataFrame:
    """Names written as encyclopaedia entities, with an alias, and read back."""
    rows = t.get("name_basics").where(F.col("primaryName") != F.upper("primaryName"))
    word = lambda c: F.struct(c.alias("value"))
    payload = F.to_json(F.struct(F.col("nconst").alias("id"), F.struct(word(F.col("primaryName")).alias("en")).alias("labels"), F.struct(F.array(word(F.upper("primaryName")), word(F.col("primaryName"))).alias("en")).alias("aliases")))
    return files.entity_names(rows.select(payload.alias("json")))


_TENTHS = "((n + 50000) // 100000)"
_COUNT = f"CASE WHEN n >= 1000000 THEN CAST({_TENTHS} // 10 AS VARCHAR) || CASE WHEN {_TENTHS} % 10 <> 0 THEN '.' || CAST({_TENTHS} % 10 AS VARCHAR) ELSE '' END || 'M' WHEN n >= 1000 THEN CAST((n + 500) // 1000 AS VARCHAR) || 'K' ELSE CAST(n AS VARCHAR) END"


@query(f"SELECT o_orderkey, {_COUNT} AS shown FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 50) AS n FROM orders)")
def compact_counts(t: Tables) -> DataFrame:
    n = F.floor("o_totalprice").cast("long") * (F.col("o_orderkey") % 50)
    return t.get("orders").select("o_orderkey", text.compact_count(n).alias("shown"))


@query(r"SELECT rec_no, CAST(pos AS INTEGER) AS pos, i AS spot, nullif(regexp_extract(url, '[?&]list=([A-Za-z0-9_-]+)', 1), '') AS playlist, nullif(regexp_extract(url, 'archive\.org/details/([^/?#]+)', 1), '') AS item, nullif(regexp_extract(url, '/wiki/([^?#]+)', 1), '') AS page FROM (SELECT rec_no, pos, CAST(unnest(range(0, len(sources))) AS INTEGER) AS i, unnest(sources).url AS url FROM cr) WHERE url IS NOT NULL")
def url_parts(t: Tables) -> DataFrame:
    urls = t.credits.select("rec_no", "pos", F.posexplode(F.filter("sources", lambda s: s.isNotNull())).alias("spot", "s")).where("s.url IS NOT NULL")
    return urls.select("rec_no", "pos", "spot", text.playlist_id("s.url").alias("playlist"), text.archive_id("s.url").alias("item"), text.wiki_page("s.url")["page"].alias("page"))


_NICK = r"trim(regexp_replace(lower(regexp_replace(strip_accents(name), '[\"“”''‘’(\[][^\"“”''‘’()\[\]]*[\"“”''‘’)\]]', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_SORT = rf"CASE WHEN len(w) < 2 THEN n ELSE w[-1] || ', ' || array_to_string(w[1:len(w) - 1], ' ') END"


@query(f"SELECT rec_no, CAST(pos AS INTEGER) AS pos, {_NICK} AS bare, {_SORT} AS sort_name, {_slug('lower(name)')} AS alias_slug FROM (SELECT *, regexp_split_to_array(n, '{_BLANK}+') AS w FROM (SELECT rec_no, pos, name, {_trim('name')} AS n FROM al WHERE name IS NOT NULL))")
def name_forms(t: Tables) -> DataFrame:
    """Names without nicknames, for sorting, and as ids of aliases (which keep no accents' letters)."""
    return t.aliases.where("name IS NOT NULL").select("rec_no", "pos", text.nickname_free_key("name").alias("bare"), text.sort_name("name").alias("sort_name"), text.slug("name", accents=False).alias("alias_slug"))


@query(f"SELECT id, regexp_replace(left({_slug(_plain('title'))}, 55), '-+$', '') AS slug, regexp_replace(left({_slug(_plain('title'))}, 24), '-+$', '') AS short, {_slug(f"regexp_replace({_plain('title')}, '(?s)\\|.*$', '')")} AS before_pipe, {_key('title')} AS key FROM (SELECT id, title FROM cs WHERE title IS NOT NULL)")
def title_slugs(t: Tables) -> DataFrame:
    return t.shows.where("title IS NOT NULL").select("id", text.slug("title", 55).alias("slug"), text.slug("title", 24).alias("short"), text.slug("title", drop_after_pipe=True).alias("before_pipe"), text.title_key("title").alias("key"))


_quoted = lambda s: "'" + s.replace("'", "''") + "'"


@query(f"SELECT rec_no, CAST(pos AS INTEGER) AS pos, CASE WHEN c <> '' AND NOT regexp_matches(c, {_quoted(text.ROLE_LABEL)}) THEN c END AS real FROM (SELECT rec_no, pos, {_trim('character')} AS c FROM cr WHERE character IS NOT NULL)")
def real_characters(t: Tables) -> DataFrame:
    return t.credits.where("character IS NOT NULL").select("rec_no", "pos", text.real_character("character").alias("real"))


_STEM = f"regexp_replace({_key('name')}, ' (podcast|show|network|rpg|productions|studio|studios|media)$', '')"


@query(
    f""", s AS (SELECT id, unnest(list_distinct([replace({_STEM}, ' ', '-'), replace({_STEM}, ' ', ''), {_slug(_key('name'))}])) AS stem FROM channels WHERE name IS NOT NULL)
    SELECT id, stem || '.' || d AS host FROM s, (SELECT unnest(['fandom.test', 'wiki.test']) AS d) WHERE stem <> ''"""
)
def candidate_wikis(t: Tables) -> DataFrame:
    return t.channels.where("name IS NOT NULL").select("id", F.explode(text.candidate_hosts("name", ["fandom.test", "wiki.test"])).alias("host"))


_WIKI = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(system, '(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>', '', 'g'), '\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]', '\1', 'g'), '\[https?://\S+ ([^\]]*)\]', '\1', 'g'), '<[^>]+>', ' ', 'g'), '''{2,}', '', 'g'), '[ \t]+', ' ', 'g'))"""


@query(rf"SELECT campaign_id, {_WIKI} AS system, regexp_replace(page, '^(?:[a-z][a-z0-9-]*:)+', '') AS page FROM wiki_campaigns WHERE system IS NOT NULL")
def clean_wikitext(t: Tables) -> DataFrame:
    return t.get("wiki_campaigns").where("system IS NOT NULL").select("campaign_id", text.wikitext_plain("system").alias("system"), text.without_interwiki("page").alias("page"))


_HTML = r"""replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|td|ul|ol|section|article)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#039;', ''''), '&amp;', '&')"""


@query(rf"SELECT doc_id, {_trim(rf"regexp_replace(regexp_replace({_HTML}, '[ \t\x{{A0}}]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g')")} AS plain FROM documents WHERE text IS NOT NULL")
def plain_texts(t: Tables) -> DataFrame:
    """Texts as lines without HTML."""
    return t.get("documents").where("text IS NOT NULL").select("doc_id", text.html_lines("text").alias("plain"))
