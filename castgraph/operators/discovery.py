"""New records and missing images from outside: what exists is kept, what is new is added, and nothing is overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castgraph.functions import text

# Words of a title from which on it counts episodes.
EPISODE_WORD = r"(?i)^(\d+[a-z]?|ep|episode|part|s\d|e\d)$"
# End of fixed values.


def new_shows(found: DataFrame, shows: DataFrame) -> DataFrame:
    """(id, title, n_pages) of found titles (title) that no show has by its title key or id; one show a key, with its least title."""
    keyed = found.where("title IS NOT NULL").select("title", text.title_key("title").alias("key")).where("key <> ''")
    made = keyed.groupBy("key").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n_pages"))
    have = shows.select(text.title_key("title").alias("key")).where("key IS NOT NULL").distinct()
    rows = made.join(have, "key", "left_anti").withColumn("id", text.slug("title", 55)).where("id <> ''")
    rows = rows.join(shows.select("id").distinct(), "id", "left_anti")
    return rows.groupBy("id").agg(F.min("title").alias("title"), F.sum("n_pages").alias("n_pages"))


def new_seasons(found: DataFrame, seasons: DataFrame) -> DataFrame:
    """(show, ordinal, title): found titles (show, title) a show has no season of, numbered on from its greatest ordinal in order of their titles."""
    bare = lambda c: F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit("and")), "[^a-z0-9]+", " "))
    made = found.where("title IS NOT NULL").select("show", "title", bare("title").alias("key")).where("key <> ''").groupBy("show", "key").agg(F.min("title").alias("title"))
    have = seasons.where("title IS NOT NULL").select("show", bare("title").alias("key")).distinct()
    last = seasons.groupBy("show").agg(F.max("ordinal").alias("_last"))
    rows = made.join(have, ["show", "key"], "left_anti").join(last, "show", "left")
    place = F.row_number().over(Window.partitionBy("show").orderBy("title"))
    return rows.select("show", (F.coalesce("_last", F.lit(0)) + place).cast("int").alias("ordinal"), "title")


def with_images(records: DataFrame, usable: Column, passes: list[tuple[str, DataFrame]]) -> DataFrame:
    """(id, url, found_by) of records without a usable image: the first pass, each (id, url), that has one for them."""
    bare = records.where(~F.coalesce(usable, F.lit(False))).select("id")
    for name, images in passes:
        bare = bare.join(images.groupBy("id").agg(F.min("url").alias(f"_{name}")), "id", "left")
    url = F.coalesce(*[F.col(f"_{name}") for name, _ in passes])
    by = F.coalesce(*[F.when(F.col(f"_{name}").isNotNull(), F.lit(name)) for name, _ in passes])
    return bare.select("id", url.alias("url"), by.alias("found_by")).where("url IS NOT NULL")


def common_title(titles: Column) -> Column:
    """Whole words all titles begin with, in any case, up to a word that counts episodes: those the least and the greatest of them share."""
    words = F.transform(titles, lambda t: F.split(F.lower(t), r"\s+"))
    low, high = F.array_min(words), F.array_max(words)
    spelt = F.split(F.get(F.filter(titles, lambda t: F.split(F.lower(t), r"\s+") == low), F.lit(0)), r"\s+")
    stop = F.array_position(F.transform(low, lambda w, i: (w != F.coalesce(F.get(high, i), F.lit(""))) | w.rlike(EPISODE_WORD)), F.lit(True))
    kept = F.when(stop == 0, spelt).otherwise(F.slice(spelt, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")))
    return F.trim(F.regexp_replace(F.array_join(kept, " "), "[-–—:|]+$", ""))


def archive_series(items: DataFrame, least: int = 3) -> DataFrame:
    """(creator, title, n_items, earliest, latest, licence) of creators with so many items (creator, title, date, licence).

    The title is what all titles begin with, or the creator's name where that is short. Only the least and the greatest title of a creator are kept
    while aggregating: what these share, all share.
    """
    words = F.split(F.lower("title"), r"\s+")
    rows = items.where("creator IS NOT NULL AND title IS NOT NULL").groupBy(F.lower("creator").alias("_key")).agg(
        F.min("creator").alias("creator"), F.count(F.lit(1)).alias("n_items"), F.min("date").alias("earliest"), F.max("date").alias("latest"), F.min("licence").alias("licence"),
        F.min(F.struct(words, "title"))["title"].alias("_low"), F.max(F.struct(words, "title"))["title"].alias("_high"),
    )
    shared = common_title(F.array("_low", "_high"))
    return rows.where(F.col("n_items") >= least).select("creator", F.when(F.length(shared) > 3, shared).otherwise(F.col("creator")).alias("title"), "n_items", "earliest", "latest", "licence")


def enriched(records: DataFrame, outside: DataFrame, columns: list[str]) -> DataFrame:
    """Records with what an outside source (id, columns) knows where they have nothing: curated values win."""
    told = outside.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(f"_{c}") for c in columns])
    return records.join(told, "id", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def first_with_hits(pages: DataFrame, host: str, template: str, ranked: list[str]) -> DataFrame:
    """The pages of each host that use the first template of a ranked list any page of the host uses."""
    rank = F.array_position(F.array(*map(F.lit, ranked)), F.col(template))
    used = pages.withColumn("_rank", rank).where("_rank > 0")
    best = used.groupBy(host).agg(F.min("_rank").alias("_rank"))
    return used.join(best, [host, "_rank"], "left_semi").drop("_rank")


def same_channel(asked: Column, found: Column) -> Column:
    """Whether a channel that was found is the one asked for: one name contains the other."""
    a, b = (F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in (asked, found))
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def overlaid(records: DataFrame, over: DataFrame, columns: list[str]) -> DataFrame:
    """Records with what a fresher source (id, columns) says laid over theirs: a podcast's feed over its directory entry."""
    told = over.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(f"_{c}") for c in columns])
    return records.join(told, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def resolved_pages(asked: DataFrame, pages: DataFrame, hops: int = 2) -> DataFrame:
    """(host, page, title, wikitext) of asked (host, page) among captured pages (host, title, wikitext), redirects followed so many times; missing pages drop out.

    Titles are compared with blanks for underscores and a capital first letter. A redirect that leads nowhere, or on and on, gives no row.
    """
    norm = lambda c: F.concat(F.upper(F.substring(F.trim(F.translate(c, "_", " ")), 1, 1)), F.substring(F.trim(F.translate(c, "_", " ")), 2, 10_000))
    target = F.nullif(F.regexp_extract("wikitext", r"(?i)^\s*#redirect\s*:?\s*\[\[([^\]|#]+)", 1), F.lit(""))
    known = pages.groupBy("host", norm(F.col("title")).alias("title")).agg(F.min("wikitext").alias("wikitext")).withColumn("_to", norm(target))
    found = asked.select("host", "page", norm(F.col("page")).alias("title")).join(known, ["host", "title"])
    for _ in range(hops):
        moved = found.where("_to IS NOT NULL").select("host", "page", F.col("_to").alias("title")).join(known, ["host", "title"])
        found = found.where("_to IS NULL").unionByName(moved)
    return found.where("_to IS NULL").select("host", "page", "title", "wikitext")


def usable_wikis(wikis: DataFrame, least: int = 20) -> DataFrame:
    """Wikis (host, articles, template) that have a campaign template and so many articles."""
    return wikis.where((F.col("articles") >= least) & F.col("template").isNotNull())


def promising_channels(channels: DataFrame, playlists: DataFrame, least: int, most: int = 6) -> DataFrame:
    """(channel, playlist, n): of channels (channel, subscribers) with so many subscribers the largest playlists (channel, playlist, n), at most so many each."""
    kept = channels.groupBy("channel").agg(F.max("subscribers").alias("s")).where(F.col("s") >= least).select("channel")
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("n"), "playlist"))
    return playlists.join(kept, "channel", "left_semi").withColumn("_p", place).where(F.col("_p") <= most).select("channel", "playlist", "n")


def matched_entities(incoming: DataFrame, people: DataFrame) -> DataFrame:
    """(key, id, by) of incoming (key, qid, name): whom we have by the same identifier, else under the name's slug; `by` is null for nobody."""
    by_qid = people.where("wikidata_qid IS NOT NULL").groupBy(F.col("wikidata_qid").alias("qid")).agg(F.min("id").alias("_q"))
    by_slug = people.select(F.col("id").alias("_slug")).distinct()
    met = incoming.join(by_qid, "qid", "left").withColumn("_key", text.slug("name")).join(by_slug, F.col("_key") == F.col("_slug"), "left")
    return met.select("key", F.coalesce("_q", "_slug").alias("id"), F.when(F.col("_q").isNotNull(), "identifier").when(F.col("_slug").isNotNull(), "name").alias("by"))
