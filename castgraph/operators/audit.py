"""Data-quality findings: (severity, what, subject), one function per rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castgraph.functions import text
from castgraph.operators import integrity

# The patterns of the rules.
PERSON_NAME = r"^[\p{Lu}][\p{L}'’-]*(?:\s+(?:[\p{Lu}]\.?|[\p{Lu}][\p{L}'’-]*))*(?:\s+(?:Jr\.?|Sr\.?|I{2,3}|IV))?$"
CHARACTER_NAME = r"[\"()]|^The |^A "
COMPANY_WORD = r"(?i)(?:^|[^A-Za-z0-9_])(studios?|sound|productions?|publishing|entertainment|media|records|llc|ltd|inc|network|games|press)(?:[^A-Za-z0-9_]|$)"
MARKUP = r"<[^>]+>|&[a-z]+;|/{2,}"
PERSON_SHAPED = r"^[\p{Lu}][\p{Ll}'’-]+(?:\s+[\p{Lu}]\.)?\s+[\p{Lu}][\p{Ll}'’-]+$"
OUT_OF_SCOPE = (
    r"talk ?show|chat show|news show|review show|\breviews\b|\binterviews?\b|discussion show|post-?show discussion|\brecaps?\b|behind the scenes|\bscripted\b|sketch comedy|animated series|\bcartoon\b"
    r"|documentary|card game|board game|video game|unboxing|highlights|tutorial|how[- ]to|streaming platform|programming block|tips,? (and )?tricks|\bexperts\b|hosted by our|share tips"
)
INSTRUCTIONAL = (
    r"(?i)\b(how to|build (an?|your)\b|building (an?|your)\b|walkthroughs?|guide to|tips|prep|worldbuilding|character creation|session zero|for beginners|tutorial|explained|rules (explained|breakdown))\b"
)
SEVERITIES = ["high", "medium", "low"]
# End of fixed values.


def _finding(rows: DataFrame, severity: str, what: str, subject) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(what).alias("what"), subject.alias("subject"))


def characters_as_people(people: DataFrame) -> DataFrame:
    name = F.col("canonical_name")
    alone = people.where((F.size("credits") == 1) & F.col("wikidata_qid").isNull() & F.col("image").isNull())
    odd = F.when(name.rlike(PERSON_NAME), F.size(F.split(name, r"\s+")) > 4).otherwise(name.rlike(CHARACTER_NAME))
    return _finding(alone.where(odd), "high", "character as a person", F.col("id"))


def named_characters(credits: DataFrame, people: DataFrame) -> DataFrame:
    """Credits (with `person` and `character`) of which a part of the character, in `part`, is another person's full name."""
    named = people.where(F.contains(F.trim("canonical_name"), F.lit(" "))).select(F.lower("canonical_name").alias("part"), F.col("id").alias("_owner"))
    parts = credits.withColumn("part", F.explode(F.split(F.lower("character"), " / ")))
    return parts.join(named, "part").where(F.col("person") != F.col("_owner")).drop("_owner")


def character_is_person(credits: DataFrame, people: DataFrame) -> DataFrame:
    """Characters of which a part equals another person's full name."""
    met = named_characters(credits.select("person", "character"), people).select("person", "part").distinct()
    return _finding(met, "high", "character is a person", F.concat_ws(":", "person", "part"))


def companies(people: DataFrame) -> DataFrame:
    return _finding(people.where(F.col("canonical_name").rlike(COMPANY_WORD)), "high", "company name", F.col("id"))


def markup(people: DataFrame) -> DataFrame:
    return _finding(people.where(F.col("canonical_name").rlike(MARKUP)), "high", "markup in a name", F.col("id"))


def person_shaped_titles(shows: DataFrame, credits: DataFrame) -> DataFrame:
    shaped = shows.where(F.col("title").rlike(PERSON_SHAPED) & F.col("links.podcast").isNull() & F.col("links.youtube").isNull())
    return _finding(shaped.join(credits.select(F.col("show").alias("id")).distinct(), "id", "left_anti"), "medium", "title like a person", F.col("id"))


def empty_seasons(shows: DataFrame, seasons: DataFrame, credits: DataFrame) -> DataFrame:
    """Shows (but solo ones) with seasons without credits: medium if all seasons are empty, else low."""
    cited = credits.select("show", F.col("season").alias("ordinal"), F.lit(True).alias("_cited")).distinct()
    counted = seasons.select("show", "ordinal").distinct().join(cited, ["show", "ordinal"], "left").groupBy("show").agg(F.count(F.lit(1)).alias("n"), F.count("_cited").alias("n_cited"))
    solo = shows.where("solo").select(F.col("id").alias("show"))
    rows = counted.where("n_cited < n").join(solo, "show", "left_anti")
    return rows.select(F.when(F.col("n_cited") == 0, "medium").otherwise("low").alias("severity"), F.lit("seasons without credits").alias("what"), F.col("show").alias("subject"))


def lone_credits(credits: DataFrame) -> DataFrame:
    rows = credits.where("season IS NOT NULL AND show IS NOT NULL").groupBy("show", "season").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return _finding(rows, "medium", "one credit in a season", F.concat_ws(":", "show", "season"))


def no_game_master(credits: DataFrame, seasons: DataFrame, games: DataFrame) -> DataFrame:
    """Seasons with three or more credits and no game master, unless all their games need none."""
    counts = credits.where("season IS NOT NULL AND show IS NOT NULL").groupBy("show", "season").agg(F.count(F.lit(1)).alias("n"), F.max(F.contains("role", F.lit("GM"))).alias("has"))
    played = seasons.select("show", F.col("ordinal").alias("season"), F.explode("game").alias("game")).join(games.select(F.col("id").alias("game"), "gm_less"), "game")
    without = played.groupBy("show", "season").agg(F.bool_and(F.coalesce("gm_less", F.lit(False))).alias("all_without")).where("all_without")
    return _finding(counts.where("n >= 3 AND NOT has").join(without, ["show", "season"], "left_anti"), "low", "no game master", F.concat_ws(":", "show", "season"))


def master_and_player(credits: DataFrame) -> DataFrame:
    """People who both run and play a season, no credit of it having a note."""
    rows = credits.where("show IS NOT NULL").groupBy("person", "show", "season").agg(
        F.max(F.contains("role", F.lit("GM"))).alias("runs"), F.max(F.contains("role", F.lit("player"))).alias("plays"), F.count("note").alias("notes")
    )
    return _finding(rows.where("runs AND plays AND notes = 0"), "medium", "runs and plays", F.concat_ws(":", "person", "show", F.coalesce(F.col("season").cast("string"), F.lit("show"))))


def shared_characters(credits: DataFrame) -> DataFrame:
    """Characters of a season (and episode) that two or more people play, unless every credit has a note."""
    named = credits.where(F.contains("role", F.lit("player")) & F.col("show").isNotNull()).withColumn("part", F.lower(text.trim("character"))).where("part <> ''")
    rows = named.groupBy("show", "season", "episode", "part").agg(F.count_distinct("person").alias("n"), F.bool_and(F.col("note").isNotNull()).alias("explained"))
    return _finding(rows.where("n >= 2 AND NOT explained"), "high", "one character, several people", F.concat_ws(":", "show", F.coalesce(F.col("season").cast("string"), F.lit("show")), F.coalesce("episode", F.lit("")), "part"))


def _games_by_key(games: DataFrame) -> DataFrame:
    """(name_key, name, ids, word): the names of games of six letters or more, editions together, with the first word of each."""
    named = games.where(F.length("name") >= 6).select("id", "name", text.normal_name("name").alias("name_key")).where("name_key <> ''")
    return named.groupBy("name_key").agg(F.min("name").alias("name"), F.collect_set("id").alias("ids")).withColumn("word", F.split("name_key", " ")[0])


def _naming(shows: DataFrame, column: str, games: DataFrame) -> DataFrame:
    """(show, name, ids): the games each show's text names; texts and names meet on the name's first word."""
    told = shows.where(F.col(column).isNotNull()).select(F.col("id").alias("show"), text.normal_name(column).alias("said"))
    words = told.select("show", F.concat(F.lit(" "), "said", F.lit(" ")).alias("said"), F.explode(F.array_distinct(F.split("said", " "))).alias("word"))
    return words.join(_games_by_key(games), "word").where(F.contains("said", F.concat(F.lit(" "), F.col("name_key"), F.lit(" ")))).select("show", "name", "ids")


def first_named(shows: DataFrame, column: str, games: DataFrame) -> DataFrame:
    """(show, name, ids): the first game by name that each text names."""
    return _naming(shows, column, games).groupBy("show").agg(F.min("name").alias("name"), F.min_by("ids", "name").alias("ids"))


def contradicted_systems(shows: DataFrame, seasons: DataFrame, games: DataFrame) -> DataFrame:
    """Titles that name a game (the first by name counts) while some season is recorded with a game of another name."""
    first = first_named(shows, "title", games)
    played = seasons.select("show", F.explode("game").alias("game")).where("game IS NOT NULL").distinct()
    rows = first.join(played, "show").groupBy("show", "name").agg(F.bool_and(F.array_contains("ids", F.col("game"))).alias("fits")).where("NOT fits")
    return _finding(rows, "high", "title contradicts system", F.concat_ws(":", "show", "name"))


def same_titles(shows: DataFrame) -> DataFrame:
    """(key, channel, n): titles that are the same but for a season's number, of shows that share a channel."""
    bare = F.regexp_replace(F.lower("title"), r"\bseason\s*\d+\b|\bs\d+\b", "")
    keyed = shows.select("id", F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " ")).alias("key"), F.explode(F.array_distinct("channels")).alias("channel")).where("key <> '' AND channel IS NOT NULL")
    return keyed.groupBy("key", "channel").agg(F.count_distinct("id").alias("n")).where("n >= 2")


def split_titles(shows: DataFrame) -> DataFrame:
    return _finding(same_titles(shows).select("key").distinct(), "medium", "split by season", F.col("key"))


def out_of_scope(shows: DataFrame) -> DataFrame:
    hit = F.lower(F.regexp_extract("description", f"(?i)({OUT_OF_SCOPE})", 1))
    return _finding(shows.select("id", hit.alias("hit")).where("hit <> ''"), "high", "description out of scope", F.concat_ws(":", "id", "hit"))


def instructional(shows: DataFrame) -> DataFrame:
    return _finding(shows.where(F.col("title").rlike(INSTRUCTIONAL)), "high", "instructional title", F.col("id"))


def other_system_named(shows: DataFrame, seasons: DataFrame, games: DataFrame) -> DataFrame:
    """Descriptions that name a game (six letters or more) no season is recorded with; the first by name is reported."""
    met = _naming(shows, "description", games)
    recorded = seasons.select("show", F.explode("game").alias("game")).where("game IS NOT NULL").groupBy("show").agg(F.collect_set("game").alias("games"))
    family = F.exists("games", lambda g: F.exists("ids", lambda i: F.startswith(g, i) | F.startswith(i, g)))
    other = met.join(recorded, "show", "left").where(~F.coalesce(family, F.lit(False)))
    return _finding(other.groupBy("show").agg(F.min("name").alias("name")), "high", "description names another system", F.concat_ws(":", "show", "name"))


def defaulted_system(shows: DataFrame, seasons: DataFrame, default: str | None, sourced: str = "System per source", more_than: int = 5) -> DataFrame:
    """One finding if more than so many shows have only the default game and no sourced line."""
    only = seasons.groupBy(F.col("show").alias("id")).agg(F.bool_and(F.coalesce(F.array_distinct("game") == F.array(F.lit(default)), F.lit(False))).alias("only")).where("only")
    rows = shows.where(~F.coalesce(F.startswith("description", F.lit(sourced)), F.lit(False))).join(only, "id", "left_semi").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return _finding(rows, "medium", "defaulted system", F.col("n").cast("string"))


def channels_without_shows(channels: DataFrame, shows: DataFrame) -> DataFrame:
    used = shows.select(F.explode("channels").alias("id")).distinct()
    return _finding(channels.join(used, "id", "left_anti"), "medium", "channel without shows", F.col("id"))


def twice_recorded(people: DataFrame) -> DataFrame:
    return _finding(integrity.same_person_pairs(people), "high", "probably the same person", F.concat_ws(":", "a", "b"))


def allowed(findings: DataFrame, allowlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings that aren't on the allowlist (what, subject), and the allowlist's entries that no finding needs."""
    return findings.join(allowlist, ["what", "subject"], "left_anti"), allowlist.join(findings, ["what", "subject"], "left_anti")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "what").agg(F.count(F.lit(1)).alias("n"))


def markdown(findings: DataFrame) -> str:
    """The report of a reviewed (small) set of findings: most severe first, grouped by kind."""
    rows = summary(findings).collect()
    lines = ["# Audit", ""]
    for r in sorted(rows, key=lambda r: (SEVERITIES.index(r["severity"]), -r["n"], r["what"])):
        lines.append(f"- {r['severity']}: {r['what']} ({r['n']})")
    return "\n".join(lines) + "\n"


def console(findings: DataFrame, most: int = 60) -> DataFrame:
    """The first findings by severity, kind and subject, with their place."""
    order = [F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.col("what"), F.col("subject")]
    return findings.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # few rows


def failed(findings: DataFrame) -> bool:
    """Whether any finding is of high severity."""
    return not findings.where("severity = 'high'").isEmpty()
