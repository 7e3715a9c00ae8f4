"""An outside catalogue resolved against our shows by exact title key, with semi joins before anything is aggregated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castgraph.functions import text
from castgraph.operators import merge

# How the catalogue's categories map to roles, and what marks a game master among characters.
CATEGORY_ROLES = {"actor": "player", "actress": "player", "self": "player", "director": "director", "producer": "producer", "writer": "writer", "composer": "composer", "editor": "editor"}
GM_CHARACTER = r"(?i)\b(dungeon|game|dungeon\s*&?\s*dragons)\s*master\b|\b(gm|dm)\b|\bkeeper\b|\bstoryteller\b|\bnarrator\b|\bfacilitator\b|\bmc\b"
SERIES_TYPES = ["tvSeries", "tvMiniSeries", "tvSpecial", "tvMovie", "video", "movie", "short", "tvShort", "podcastSeries", "webSeries"]
# End of fixed values.


def title_matches(shows: DataFrame, basics: DataFrame) -> DataFrame:
    """(show, tconst, year): titles of series types whose primary or original title has the key of one of our titles; the primary one decides.

    The cheap type filter comes before any key is computed. Titles that came twice count once.
    """
    ours = shows.where("title IS NOT NULL").select(F.col("id").alias("show"), text.title_key("title").alias("key")).where("key <> ''")
    kept = basics.where(F.col("titleType").isin(SERIES_TYPES)).select("tconst", "primaryTitle", "originalTitle", text.known("startYear").alias("year")).distinct()
    theirs = kept.select("tconst", "year", F.posexplode(F.array(text.title_key(text.known("primaryTitle")), text.title_key(text.known("originalTitle")))).alias("place", "key"))
    met = theirs.join(ours, "key")
    return met.groupBy("tconst").agg(F.min(F.struct("place", "show")).alias("m"), F.max("year").alias("year")).select("m.show", "tconst", F.expr("try_cast(year AS int)").alias("year"))


def catalogue_credit(category: Column, characters: Column) -> Column:
    """struct(role, character) of a principal, or null for jobs that don't count and for "self" without a character.

    Malformed characters are none. A character that names the game master makes the role so.
    """
    names = F.filter(F.transform(F.from_json(text.known(characters), "array<string>"), text.real_character), lambda c: c.isNotNull())
    names = F.coalesce(names, F.array().cast("array<string>"))
    role = F.coalesce(*[F.when(category == k, F.lit(v)) for k, v in CATEGORY_ROLES.items()])
    runs = F.exists(names, lambda n: n.rlike(GM_CHARACTER))
    none = F.lit(None).cast("string")
    return (
        F.when((role == "player") & runs, F.struct(F.lit("GM/DM").alias("role"), none.alias("character")))
        .when((role == "player") & (F.size(names) == 0) & (category == "self"), None)
        .when(role == "player", F.struct(role.alias("role"), F.nullif(F.array_join(names, " / "), F.lit("")).alias("character")))
        .when(role.isNotNull(), F.struct(role.alias("role"), none.alias("character")))
    )


def title_credits(matches: DataFrame, principals: DataFrame, names: DataFrame) -> DataFrame:
    """(show, tconst, nconst, role, character, name): one credit per title, person and role, preferring one with a character, then the least ordering."""
    kept = principals.join(matches.select("tconst").distinct(), "tconst", "left_semi")
    made = kept.select("tconst", "nconst", F.expr("try_cast(ordering AS int)").alias("ordering"), catalogue_credit(F.col("category"), F.col("characters")).alias("c")).where("c IS NOT NULL")
    best = made.groupBy("tconst", "nconst", F.col("c.role").alias("role")).agg(F.min(F.struct(F.col("c.character").isNull().alias("silent"), "ordering", F.col("c.character").alias("character"))).alias("b"))
    needed = names.join(best.select("nconst").distinct(), "nconst", "left_semi").select("nconst", text.known("primaryName").alias("name"))
    return best.join(matches.select("tconst", "show"), "tconst").join(needed, "nconst").select("show", "tconst", "nconst", "role", F.col("b.character").alias("character"), "name")


def with_episodes(principals: DataFrame, episodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Principals of matched titles and of their episodes, the latter under their series: `episodes` has (tconst, parentTconst).

    Only episodes of matched series are kept before they meet the principals.
    """
    series = matches.select("tconst").distinct()
    kept = episodes.join(series.withColumnRenamed("tconst", "parentTconst"), "parentTconst", "left_semi").groupBy("tconst").agg(F.min("parentTconst").alias("_parent"))
    of_episodes = principals.join(kept, "tconst").withColumn("tconst", F.col("_parent")).drop("_parent")
    return principals.join(series, "tconst", "left_semi").unionByName(of_episodes)


def incoming(credits: DataFrame, reviewed: DataFrame, seasons: DataFrame, by_name: DataFrame) -> DataFrame:
    """Credits of the best title of each show, if it is accepted, as (id, is_new, name, show, season, role, character, confirmed, n_seasons, tconst).

    A name means the person who has it, in any case, else a new one of its slug. Season 1 is claimed only where a show has just one season;
    a character that is the person's own name is none.
    """
    place = F.row_number().over(Window.partitionBy("show").orderBy(F.desc("overlap"), F.desc("familiar"), "tconst"))
    taken = reviewed.withColumn("_p", place).where("_p = 1 AND verdict = 'accepted'").select("show", "tconst", (F.col("overlap") > 0).alias("confirmed"))
    counts = seasons.groupBy("show").agg(F.count(F.lit(1)).alias("n_seasons"))
    rows = credits.where("name IS NOT NULL").join(taken, ["show", "tconst"]).join(counts, "show", "left").withColumn("_key", F.lower("name"))
    met = rows.join(by_name.select(F.col("name").alias("_key"), F.col("id").alias("_id")), "_key", "left")
    made = met.select(
        F.coalesce("_id", text.slug("name")).alias("id"), F.col("_id").isNull().alias("is_new"), "name", "show", F.when(F.col("n_seasons") == 1, 1).alias("season"), "role",
        F.when(F.lower("character") != F.lower("name"), F.col("character")).alias("character"), "confirmed", F.coalesce("n_seasons", F.lit(0)).alias("n_seasons"), "tconst",
    )
    return made.where("id <> ''")


def created(rows: DataFrame) -> DataFrame:
    """(id, canonical_name) of the people an import creates."""
    return rows.where("is_new").groupBy("id").agg(F.min("name").alias("canonical_name"))


def import_credits(people: DataFrame, rows: DataFrame) -> DataFrame:
    """The people touched by the import, new ones included, with its credits folded in (id, credits): evidence is added, nothing is overwritten."""
    notes = F.concat_ws(" ", F.when(~F.col("confirmed"), "Matched by title alone."), F.when(F.col("n_seasons") > 1, "Which seasons it covers is not established."))
    source = F.struct(F.concat(F.lit("https://catalogue.test/title/"), "tconst").alias("url"), F.lit("Full cast, by the catalogue's data sets.").alias("note"), F.lit("reference").alias("tier"), F.lit(None).cast("string").alias("attested_by"), F.lit(None).cast("string").alias("locator"))
    none = F.lit(None).cast("string")
    alias = people.select("id", F.when(F.size("aliases") == 1, F.get("aliases", F.lit(0))["id"]).alias("_alias"))
    told = rows.join(alias, "id", "left").select(
        "id", F.struct("show", "role", "tconst", "character").alias("seq"),
        F.struct("show", "season", none.alias("episode"), "role", "character", F.col("_alias").alias("alias"), none.alias("year"), F.nullif(notes, F.lit("")).alias("note"), F.array(source).alias("sources")).alias("credit"),
    )
    touched = rows.select("id").distinct().join(people.select("id", "credits"), "id", "left")
    return merge.upsert_batch(touched, told)


def scores(matches: DataFrame, credits: DataFrame, cast: DataFrame, known_names: DataFrame) -> DataFrame:
    """(show, tconst, n_people, overlap, familiar, place): how many of a title's people are in our cast, how many we know at all, best title first.

    `cast` has (show, name_key), `known_names` (name_key).
    """
    people = credits.select("show", "tconst", "nconst", text.normal_name("name").alias("name_key")).distinct()
    marked = people.join(cast.withColumn("in_cast", F.lit(1)).distinct(), ["show", "name_key"], "left").join(known_names.distinct().withColumn("is_known", F.lit(1)), "name_key", "left")
    return marked.groupBy("show", "tconst").agg(F.count_distinct("nconst").alias("n_people"), F.count("in_cast").alias("overlap"), F.count("is_known").alias("familiar"))


def review(scored: DataFrame, years: DataFrame, earliest: int = 2005, most_people: int = 40, least_familiar: int = 2) -> DataFrame:
    """Adds `verdict`: accepted, or why a match by title alone is left for review: too early, too many people, too few known."""
    joined = scored.join(years, "tconst", "left")
    return joined.withColumn(
        "verdict",
        F.when(F.col("overlap") > 0, "accepted").when(F.col("year") < earliest, "too early").when(F.col("n_people") > most_people, "too many people").when(F.col("familiar") < least_familiar, "too few known").otherwise("accepted"),
    )


def people_by_name(people: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id): whom a lower-case name means, canonical or alias; of several the last record wins."""
    own = people.select(F.lower("canonical_name").alias("name"), "id", "rec_no", F.lit(-1).alias("pos"))
    other = aliases.select(F.lower("name").alias("name"), F.col("person").alias("id"), "rec_no", "pos")
    return own.unionByName(other).where("name IS NOT NULL").groupBy("name").agg(F.max_by("id", F.struct("rec_no", "pos")).alias("id"))
