"""Publication: JSON collections, linked data, manifests, listings and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castgraph.functions import text
from castgraph.operators import relations


def as_json(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, json): each record as JSON; null fields are left out."""
    return records.select(F.col(key), F.to_json(F.struct(*records.columns)).alias("json"))


def write_collection(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def person_linked_data(people: DataFrame) -> DataFrame:
    """(id, json): schema.org data of each person, without keys that have no value; < is escaped for embedding."""
    also = F.array_compact(F.array("links.website", "links.wikipedia", F.when(F.col("wikidata_qid").rlike(r"\AQ[0-9]+\z"), F.concat(F.lit("https://www.wikidata.org/wiki/"), "wikidata_qid"))))
    other = F.array_distinct(F.filter(F.transform("aliases", lambda a: a["name"]), lambda n: n != F.col("canonical_name")))
    body = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("Person").alias("@type"), F.col("canonical_name").alias("name"),
        F.when(F.size(other) > 0, other).alias("alternateName"), F.col("image.url").alias("image"), F.when(F.size(also) > 0, also).alias("sameAs"),
    )
    return people.select("id", F.replace(F.to_json(body), F.lit("<"), F.lit("\\u003c")).alias("json"))


def show_linked_data(shows: DataFrame) -> DataFrame:
    body = F.struct(
        F.lit("https://schema.org").alias("@context"), F.when(F.col("format") == "podcast", "PodcastSeries").otherwise("CreativeWorkSeries").alias("@type"), F.col("title").alias("name"),
        F.col("description"), F.col("image.url").alias("image"), F.nullif(F.greatest(F.coalesce(F.size("seasons"), F.lit(0)), F.lit(0)), F.lit(0)).alias("numberOfSeasons"),
    )
    return shows.select("id", F.replace(F.to_json(body), F.lit("<"), F.lit("\\u003c")).alias("json"))


def manifest(counts: DataFrame, base: str) -> dict:
    """Counts per collection and where each is published; a handful of rows."""
    return {"counts": {r["kind"]: r["n"] for r in counts.collect()}, "endpoints": {r["kind"]: f"{base}/api/{r['kind']}.json" for r in counts.collect()}}


def sitemap(records: DataFrame, prefix: str, hidden=None) -> DataFrame:
    shown = records if hidden is None else records.where(~hidden)
    return shown.select(F.concat(F.lit(prefix), "id", F.lit("/")).alias("url")).distinct()


def facet_table(shows: DataFrame, seasons: DataFrame, games: DataFrame) -> DataFrame:
    """What the show listing filters by: format, channels, games and editions of each show."""
    played = seasons.select("show", F.explode("game").alias("game")).join(games.select(F.col("id").alias("game"), "name", "edition"), "game")
    played = played.groupBy(F.col("show").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("games"), F.array_sort(F.collect_set("edition")).alias("editions"))
    return shows.select("id", "title", "format", "channels").join(played, "id", "left")


def faceted(facets: DataFrame, format: str | None = None, channel: str | None = None, game: str | None = None, edition: str | None = None) -> DataFrame:
    """Shows that fit all given facets."""
    for condition in [
        F.col("format") == format if format else None,
        F.array_contains("channels", channel) if channel else None,
        F.array_contains("games", game) if game else None,
        F.array_contains("editions", edition) if edition else None,
    ]:
        if condition is not None:
            facets = facets.where(condition)
    return facets


def search_names(people: DataFrame, aliases: DataFrame, asked: str) -> DataFrame:
    """(id, name): one hit per person, its canonical name before its aliases, for a text contained in it."""
    names = people.select("id", F.lit(-1).alias("pos"), F.col("canonical_name").alias("name")).unionByName(aliases.select(F.col("person").alias("id"), "pos", "name"))
    wanted = text.normal_name(F.lit(asked))
    hits = names.where(F.contains(text.normal_name("name"), wanted) & (wanted != ""))
    return hits.groupBy("id").agg(F.min_by("name", "pos").alias("name"))


def inverted_index(documents: DataFrame, key: str, column: str) -> DataFrame:
    """(word, key, tf): how often each document has each word."""
    words = documents.select(key, F.explode(F.split(text.normal_name(column), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word", key).agg(F.count(F.lit(1)).alias("tf"))


def search_text(index: DataFrame, key: str, asked: list[str], total: DataFrame, top: int = 8) -> DataFrame:
    """The best documents for the words by TF-IDF; equals in order of their key. `total` is one row with n_documents."""
    hits = index.where(F.col("word").isin(asked))
    df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, "word").crossJoin(F.broadcast(total)).groupBy(key).agg(F.sum((1 + F.log("tf")) * F.log((F.col("n_documents") + 1) / F.col("df"))).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(top)


def resolve_person(people: DataFrame, asked: str) -> DataFrame:
    """(id,): the one person a text means: by id, else by canonical name, else by an alias, in any case; of several the least id."""
    now = relations.current(people)
    slug, lower = text.slug(F.lit(asked)), F.lower(F.lit(asked))
    how = F.when(F.col("id") == slug, 0).when(F.lower("canonical_name") == lower, 1).when(F.coalesce(F.exists("aliases", lambda a: F.lower(a["name"]) == lower), F.lit(False)), 2)
    return now.select("id", how.alias("how")).where("how IS NOT NULL").orderBy("how", "id").limit(1).select("id")


def person_page(people: DataFrame, shows: DataFrame, channels: DataFrame, games: DataFrame, asked: str) -> DataFrame:
    """The resolved credits of the person a text means, in the order of the page: shows by their latest year, undated last; within a show by season and episode.

    The person is found before any credit is unfolded; only the shows of these credits are resolved.
    """
    found = resolve_person(people, asked)
    one = people.join(F.broadcast(found), "id", "left_semi")  # one row
    cited = one.select(F.explode("credits").alias("_c")).select(F.col("_c.show").alias("id")).distinct()
    resolved = relations.resolved_credits(one, shows.join(cited, "id", "left_semi"), channels, games)
    latest = F.max(F.coalesce("year", "started")).over(Window.partitionBy("show"))
    place = F.row_number().over(Window.orderBy(F.col("latest").desc_nulls_last(), "show_title", "show", F.coalesce("season", F.lit(0)), F.coalesce("episode", F.lit("")), "pos"))  # one person
    rows = resolved.withColumn("latest", latest).withColumn("place", place)
    return rows.select("person", "pos", "show", "show_title", "season", "role", "character", "games", "channels", "n_origins", "place")


def described(urls: Column) -> Column:
    """Distinct links as structs (label, kind, host, url) in order of their kinds; of equals the first given; what is no URL drops out."""
    order = F.create_map(*[F.lit(x) for kv in text.LINK_ORDER.items() for x in kv])
    links = F.transform(F.array_distinct(F.array_compact(urls)), lambda u, i: F.struct(F.coalesce(order[text.link_label(u)["kind"]], F.lit(9)).alias("order"), i.alias("at"), text.link_label(u)["label"].alias("label"), text.link_label(u)["kind"].alias("kind"), text.link_label(u)["host"].alias("host"), u.alias("url")))
    return F.transform(F.array_sort(F.filter(links, lambda x: x["label"].isNotNull())), lambda x: F.struct(x["label"].alias("label"), x["kind"].alias("kind"), x["host"].alias("host"), x["url"].alias("url")))


def _embedded(body: Column) -> Column:
    return F.replace(F.to_json(body), F.lit("<"), F.lit("\\u003c"))


def channel_linked_data(channels: DataFrame) -> DataFrame:
    body = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Organization").alias("@type"), "name", "description", F.col("links.website").alias("url"))
    return channels.select("id", _embedded(body).alias("json"))


def season_linked_data(shows: DataFrame, seasons: DataFrame) -> DataFrame:
    rows = seasons.join(shows.select(F.col("id").alias("show"), F.col("title").alias("_series")), "show")
    series = F.struct(F.lit("CreativeWorkSeries").alias("@type"), F.col("_series").alias("name"))
    body = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("CreativeWorkSeason").alias("@type"), F.col("title").alias("name"), F.col("ordinal").alias("seasonNumber"), F.col("episode_count").alias("numberOfEpisodes"),
        F.col("started").alias("startDate"), F.col("ended").alias("endDate"), series.alias("partOfSeries"),
    )
    return rows.select("show", "ordinal", _embedded(body).alias("json"))


def front_text(people: DataFrame, shows: DataFrame, credits: DataFrame, base: str) -> DataFrame:
    """(body,): one row of text with the counts of the collections."""
    counts = credits.agg(F.count(F.lit(1)).alias("credits"), F.count_if(F.col("status") == "corroborated").alias("corroborated"))
    for name, df in (("people", people), ("shows", shows)):
        counts = counts.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))  # one row
    lines = [F.lit("# Cast"), F.lit(""), *[F.concat(F.lit(f"{label}: "), F.col(name).cast("string")) for label, name in (("People", "people"), ("Shows", "shows"), ("Credits", "credits"), ("Corroborated", "corroborated"))], F.lit(""), F.lit(f"{base}/api/index.json"), F.lit("")]
    return counts.select(F.concat_ws("\n", *lines).alias("body"))


def write_entities(records: DataFrame, path: str, key: str = "id") -> None:
    """One folder per entity with its JSON."""
    records.withColumn("_key", F.col(key)).write.mode("overwrite").partitionBy("_key").json(path)


def contribution(show: Column, season: Column, role: Column, character: Column, url: Column) -> Column:
    """The YAML of one credit as somebody would contribute it; what is unknown is left out."""
    lines = [F.concat(F.lit("- show: "), text.yaml_quoted(show)), F.concat(F.lit("  season: "), season.cast("string")), F.concat(F.lit("  role: "), text.yaml_quoted(role)), F.concat(F.lit("  character: "), text.yaml_quoted(character)), F.concat(F.lit("  sources:\n    - url: "), text.yaml_quoted(url))]
    return F.concat_ws("\n", *lines)
