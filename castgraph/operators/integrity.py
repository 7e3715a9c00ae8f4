"""Uniqueness, referential integrity, schema rules and probable duplicates, each reported as rows rather than raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph import model
from castgraph.functions import text
from castgraph.operators import relations

SLUG = r"\A[a-z0-9]+(?:-[a-z0-9]+)*\z"
PARTIAL_DATE = r"\A\d{4}(-\d{2}(-\d{2})?)?\z"
QID = r"\AQ[1-9]\d*\z"


def duplicate_ids(records: DataFrame) -> DataFrame:
    """Ids that occur more than once, with the number of extra records."""
    return records.where("id IS NOT NULL").groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n_extra")).where("n_extra > 0")


def dangling_channels(shows: DataFrame, channels: DataFrame) -> DataFrame:
    """References of shows to channels that don't exist, with their array index."""
    refs = shows.select("rec_no", "id", F.posexplode("channels").alias("pos", "channel")).where("channel IS NOT NULL")
    return refs.join(channels.select(F.col("id").alias("channel")), "channel", "left_anti")


def dangling_seasons(credits: DataFrame, seasons: DataFrame, shows: DataFrame) -> DataFrame:
    """Credits to a season an existing show doesn't have, with the ordinals it has in stored order."""
    has = seasons.groupBy("show").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ordinal"))), lambda s: s["ordinal"].cast("string")), ", ").alias("available"))
    ordinals = seasons.select("show", F.col("ordinal").alias("season")).distinct()
    refs = credits.where("season IS NOT NULL").select("person", "rec_no", "pos", "show", "season")
    missing = refs.join(shows.select(F.col("id").alias("show")).distinct(), "show", "left_semi").join(ordinals, ["show", "season"], "left_anti")
    return missing.join(has, "show", "left")


def shared_names(aliases: DataFrame) -> DataFrame:
    """Normalised names that two or more people have, with their sorted ids."""
    named = aliases.withColumn("name_key", text.normal_name("name")).where("name_key <> ''")
    groups = named.groupBy("name_key").agg(F.array_sort(F.collect_set("person")).alias("people"))
    return groups.where(F.size("people") >= 2).select("name_key", F.array_join("people", "|").alias("people"), F.size("people").alias("n_people"))


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def _rules(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in pairs]))


def _any(array: str, test) -> Column:
    return F.coalesce(F.exists(F.filter(array, lambda x: x.isNotNull()), test), F.lit(False))


def _every(credits_test) -> Column:
    return _any("credits", credits_test)


def _source_test(test):
    return lambda c: F.coalesce(F.exists(F.filter(c["sources"], lambda s: s.isNotNull()), test), F.lit(False))


def url_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(url)), "/$", "")


def _cited_twice(c: Column) -> Column:
    keys = F.transform(F.filter(c["sources"], lambda s: s["url"].isNotNull()), lambda s: url_key(s["url"]))
    return F.coalesce(F.size(keys) != F.size(F.array_distinct(keys)), F.lit(False))


def person_rules() -> list[tuple[str, Column]]:
    """The rules of a person record by name; a rule whose condition is true is broken."""
    names = F.array_compact(F.transform("aliases", lambda a: a["name"]))
    ids = F.filter(F.transform("aliases", lambda a: a["id"]), lambda i: i.isNotNull())
    return [
        ("required", F.col("id").isNull() | _blank(F.col("canonical_name"))),
        ("slug", ~F.col("id").rlike(SLUG)),
        ("qid", ~F.col("wikidata_qid").rlike(QID)),
        ("fair_use_rationale", (F.col("image.licence") == "fair use") & _blank(F.col("image.rationale"))),
        ("alias_ids_unique", F.coalesce(F.size(ids) != F.size(F.array_distinct(ids)), F.lit(False))),
        ("canonical_among_aliases", F.col("canonical_name").isNotNull() & ~F.coalesce(F.array_contains(names, F.col("canonical_name")), F.lit(False))),
        ("alias_type", _any("aliases", lambda a: ~a["alias_type"].isin(model.ALIAS_TYPES))),
        ("alias_dates", _any("aliases", lambda a: ~a["active_from"].rlike(PARTIAL_DATE) | ~a["active_to"].rlike(PARTIAL_DATE))),
        ("credit_role", _every(lambda c: ~c["role"].isin(model.CREDIT_ROLES))),
        ("credit_year", _every(lambda c: ~c["year"].rlike(PARTIAL_DATE))),
        ("credit_season_positive", _every(lambda c: c["season"] <= 0)),
        ("credit_sources", _every(lambda c: F.coalesce(F.size(c["sources"]), F.lit(0)) <= 0)),
        ("episode_needs_season", _every(lambda c: c["episode"].isNotNull() & c["season"].isNull())),
        ("url_cited_twice", _every(_cited_twice)),
        ("guest_needs_detail", _every(lambda c: c["role"].isin("guest player", "guest GM") & c["episode"].isNull() & c["note"].isNull())),
        ("source_tier", _every(_source_test(lambda s: ~s["tier"].isin(model.TIERS)))),
        ("source_needs_evidence", _every(_source_test(lambda s: _blank(s["url"]) & _blank(s["note"])))),
        ("attested_tier", _every(_source_test(lambda s: s["tier"].isin("firsthand", "participant") & s["attested_by"].isNull()))),
        ("recording_locator", _every(_source_test(lambda s: (s["tier"] == "recording") & F.coalesce(s["locator"], s["url"]).isNull()))),
    ]


def show_rules() -> list[tuple[str, Column]]:
    ordinals = F.filter(F.transform("seasons", lambda s: s["ordinal"]), lambda o: o.isNotNull())
    return [
        ("required", F.col("id").isNull() | _blank(F.col("title"))),
        ("slug", ~F.col("id").rlike(SLUG)),
        ("has_channel", F.coalesce(F.size("channels"), F.lit(0)) <= 0),
        ("format", ~F.col("format").isin(model.FORMATS)),
        ("status", ~F.col("status").isin(model.STATUSES)),
        ("fair_use_rationale", (F.col("image.licence") == "fair use") & _blank(F.col("image.rationale"))),
        ("season_ordinals_unique", F.coalesce(F.size(ordinals) != F.size(F.array_distinct(ordinals)), F.lit(False))),
        ("season_ordinal_positive", _any("seasons", lambda s: (s["ordinal"] <= 0) | (s["episode_count"] <= 0))),
        ("season_dates", _any("seasons", lambda s: ~s["started"].rlike(PARTIAL_DATE) | ~s["ended"].rlike(PARTIAL_DATE))),
    ]


def violations(records: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """(rec_no, id, rule) for each rule a record breaks; all rules in one pass, without a shuffle."""
    broken = _rules([(name, F.coalesce(condition, F.lit(False))) for name, condition in rules])
    return records.select("rec_no", "id", F.explode(broken).alias("rule"))


def good_records(records: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """The records that break no rule."""
    bad = F.lit(False)
    for _, condition in rules:
        bad = bad | F.coalesce(condition, F.lit(False))
    return records.where(~bad)


def same_person_pairs(people: DataFrame) -> DataFrame:
    """Pairs of ids whose names have the same last word and first words of which one begins the other, both of three letters or more.

    Pairs must share the last word, so they are joined on it and on the first three letters of the first word: nothing is lost
    (equal first words of fewer letters have a key of their own).
    """
    words = F.split(text.name_key("canonical_name"), " ")
    keyed = people.select("id", words.alias("w")).where(F.size("w") >= 2).select("id", F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last")).distinct()
    keyed = keyed.withColumn("start", F.left("first", F.lit(3)))
    a, b = keyed.toDF("a", "a_first", "last", "start"), keyed.toDF("b", "b_first", "last", "start")
    alike = (F.col("a_first") == F.col("b_first")) | ((F.length("a_first") >= 3) & (F.length("b_first") >= 3) & (F.startswith("a_first", F.col("b_first")) | F.startswith("b_first", F.col("a_first"))))
    return a.join(b, ["last", "start"]).where((F.col("a") < F.col("b")) & alike).select("a", "b").distinct()


def problems(people: DataFrame, shows: DataFrame) -> DataFrame:
    """(collection, rec_no, problem): every rule a record breaks."""
    of = lambda df, rules, name: violations(df, rules).select(F.lit(name).alias("collection"), "rec_no", F.col("rule").alias("problem"))
    return of(people, person_rules(), "people").unionByName(of(shows, show_rules(), "shows"))


def report(found: DataFrame) -> DataFrame:
    """(collection, rec_no, n_problems, problems): problems grouped by record; a record breaks each rule once, so the list is bounded."""
    return found.groupBy("collection", "rec_no").agg(F.count(F.lit(1)).alias("n_problems"), F.array_join(F.array_sort(F.collect_list("problem")), "|").alias("problems"))


def checked(people: DataFrame, shows: DataFrame, show_most: int = 20) -> tuple[DataFrame, DataFrame]:
    """The tables as they are, or an error that names the first problems if there is any."""
    first = problems(people, shows).orderBy("collection", "rec_no", "problem").limit(show_most).collect()
    if first:
        raise ValueError("refused: " + "; ".join(f"{p['collection']}:{p['rec_no']} {p['problem']}" for p in first))
    return people, shows


def shared_display(aliases: DataFrame) -> DataFrame:
    """(name_key, display): for each name key of two or more people the last matching alias of the person with the least rec_no."""
    keyed = aliases.where("name IS NOT NULL").select("person", "rec_no", "pos", "name", text.normal_name("name").alias("name_key")).where("name_key <> ''")
    rows = keyed.groupBy("name_key").agg(F.count_distinct("person").alias("n"), F.max_by("name", F.struct(-F.col("rec_no"), "pos")).alias("display"))
    return rows.where("n >= 2").select("name_key", "display")
