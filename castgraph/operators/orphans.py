"""References whose target is absent, withdrawn or not yet there, found without being slowed down by hot keys.

References are first counted per key and period (partial counts before the shuffle), so a key costs one row per period, however many
references it has. Heavy keys are looked up in a broadcast, all others in a shuffled anti-join; the orphan counts of both are united.
Single references are read only of keys that may be orphans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph.session import cut

#: A key is heavy if it holds at least this share of all references, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 0.001


def month(column: str) -> Column:
    return F.date_format(column, "yyyy-MM")


def count_references(refs: DataFrame, keys: list[str]) -> DataFrame:
    """References (with `loaded_at`) counted per key columns and month: (*keys, period, n_refs, first_at, last_at)."""
    return refs.groupBy(*keys, month("loaded_at").alias("period")).agg(F.count(F.lit(1)).alias("n_refs"), F.min("loaded_at").alias("first_at"), F.max("loaded_at").alias("last_at"))


def anti_counts(counts: DataFrame, key: str, targets: DataFrame, target_key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The rows of `counts` (with n_refs) whose key is no target's: heavy keys are checked by a broadcast, the others by a shuffled anti-join.

    At most 1 / share keys are heavy, which bounds both broadcasts. A null key is no reference. An empty input gives an empty result.
    """
    counts = counts.where(F.col(key).isNotNull())
    of_key = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("n_refs").alias("_n"))
    total = of_key.agg(F.sum("_n").alias("_total"))
    heavy = cut(of_key.crossJoin(F.broadcast(total)).where(F.col("_n") >= F.col("_total") * share).select("_key"))  # total has one row
    known = targets.select(F.col(target_key).alias("_target"))
    absent = heavy.join(F.broadcast(known.join(F.broadcast(heavy), F.col("_target") == F.col("_key"), "left_semi").select("_target").distinct()), F.col("_key") == F.col("_target"), "left_anti")
    hot = counts.join(F.broadcast(absent), F.col(key) == F.col("_key"), "left_semi")
    rest = counts.join(F.broadcast(heavy), F.col(key) == F.col("_key"), "left_anti").hint("shuffle_merge").join(known, F.col(key) == F.col("_target"), "left_anti")
    return hot.unionByName(rest)


def _elements(df: DataFrame, array: str) -> DataFrame:
    """Each element of the array that is not null, with its position from 0."""
    return df.select(*[c for c in df.columns if c != array], F.posexplode(array).alias("pos", "_e")).where(F.col("_e").isNotNull())


def show_targets(shows: DataFrame) -> DataFrame:
    """(show, first, removed, ordinals): one row per id, existing from its earliest loaded_at, removed from its earliest removed_at."""
    targets = shows.where(F.col("id").isNotNull()).select("id", "loaded_at", "removed_at", F.transform("seasons", lambda s: s["ordinal"]).alias("_ordinals"))
    return targets.groupBy(F.col("id").alias("show")).agg(
        F.min("loaded_at").alias("first"),
        F.min("removed_at").alias("removed"),
        F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.array_compact("_ordinals"), F.array().cast("array<int>"))))).alias("ordinals"),
    )


def credit_references(people: DataFrame) -> DataFrame:
    """(rec_no, loaded_at, pos, show, season, alias, has_alias) of each credit."""
    local = F.transform(F.coalesce("aliases", F.array()), lambda a: a["id"])
    credits = _elements(people.select("rec_no", "loaded_at", local.alias("_alias_ids"), "credits"), "credits")
    has_alias = F.coalesce(F.exists("_alias_ids", lambda a: a == F.col("_e.alias")), F.lit(False))
    return credits.select("rec_no", "loaded_at", "pos", F.col("_e.show").alias("show"), F.col("_e.season").alias("season"), F.col("_e.alias").alias("alias"), has_alias.alias("has_alias"))


def suspects(credits: DataFrame, targets: DataFrame) -> DataFrame:
    """(show, season, first, removed, exists, lacks): the keys (show, season) of which some reference may be an orphan, by their counts per month alone.

    A key is suspect if its show does not exist, was removed before the last or first loaded after the earliest of its references, or lacks the season.
    """
    counts = count_references(credits.where(F.col("show").isNotNull()), ["show", "season"])
    missing = anti_counts(counts, "show", targets, "show").select("show", "season").distinct()
    span = counts.groupBy("show", "season").agg(F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    lacks = F.col("season").isNotNull() & ~F.array_contains("ordinals", F.col("season"))
    kept = span.join(targets, "show").withColumn("lacks", F.coalesce(lacks, F.lit(False)))
    kept = kept.where(F.col("lacks") | (F.col("removed") <= F.col("last_at")) | (F.col("first") > F.col("first_at"))).select("show", "season", "first", "removed", F.lit(True).alias("exists"), "lacks")
    return kept.unionByName(missing.withColumns({"exists": F.lit(False), "lacks": F.lit(False)}), allowMissingColumns=True)


def credit_orphans(people: DataFrame, shows: DataFrame) -> DataFrame:
    """Orphan references of people's credits: (src, rec_no, pos, field, ref, status, loaded_at).

    Null credits, null shows, null seasons and null aliases are no reference. A show that came several times counts as
    existing from its earliest loaded_at and as removed from its earliest removed_at; it has every ordinal any of its rows has.
    A null loaded_at of a people row makes no reference removed or late. Repeated people rows are distinct by rec_no.
    """
    credits = credit_references(people)
    found = cut(suspects(credits, show_targets(shows)))
    own = credits.where(F.col("alias").isNotNull() & ~F.col("has_alias"))
    aliases = own.select("rec_no", "pos", F.lit("alias").alias("field"), F.col("alias").alias("ref"), F.lit("missing").alias("status"), "loaded_at")
    looked = credits.where(F.col("show").isNotNull()).alias("c").join(found.alias("f"), (F.col("c.show") == F.col("f.show")) & F.col("c.season").eqNullSafe(F.col("f.season")))
    status = F.when(~F.col("exists"), "missing").when(F.col("removed") <= F.col("loaded_at"), "removed").when(F.col("first") > F.col("loaded_at"), "late")
    finding = lambda field, ref, state: F.when(state.isNotNull(), F.struct(F.lit(field).alias("field"), ref.alias("ref"), state.alias("status")))
    both = F.array_compact(F.array(finding("show", F.col("c.show"), status), finding("season", F.col("c.season").cast("string"), F.when(F.col("lacks"), "missing"))))
    keyed = looked.select("rec_no", "pos", "loaded_at", F.explode(both).alias("_f")).select("rec_no", "pos", "_f.field", "_f.ref", "_f.status", "loaded_at")
    return keyed.unionByName(aliases).select(F.lit("people").alias("src"), "rec_no", "pos", "field", "ref", "status", "loaded_at")


def game_references(shows: DataFrame) -> DataFrame:
    """(rec_no, loaded_at, pos, ref): each season's references to games, once per season and id; null ids are no reference."""
    seasons = _elements(shows.select("rec_no", "loaded_at", "seasons"), "seasons").select("rec_no", "loaded_at", "pos", F.explode(F.array_distinct("_e.game")).alias("ref"))
    return seasons.where(F.col("ref").isNotNull())


def game_orphans(shows: DataFrame, games: DataFrame) -> DataFrame:
    """Seasons' references to games that do not exist."""
    seasons = game_references(shows)
    targets = games.where(F.col("id").isNotNull()).select("id")
    missing = cut(anti_counts(count_references(seasons, ["ref"]), "ref", targets, "id").select("ref").distinct())
    return seasons.join(missing, "ref", "left_semi").select(F.lit("shows").alias("src"), "rec_no", "pos", F.lit("game").alias("field"), "ref", F.lit("missing").alias("status"), "loaded_at")


def orphan_references(people: DataFrame, shows: DataFrame, games: DataFrame) -> DataFrame:
    """Every orphan reference of people and shows with the loaded_at of the row that holds it."""
    return credit_orphans(people, shows).unionByName(game_orphans(shows, games))


def orphan_counts(people: DataFrame, shows: DataFrame, games: DataFrame) -> DataFrame:
    """Orphans per table, field, status and month of loaded_at (`period`, null for a null loaded_at): (src, field, status, period, n_refs, n_keys).

    Keys that do not exist, and seasons and games that lack, are counted from the counts per key and month; single references are looked at
    only for shows that came late or were removed between a month's first and last reference.
    """
    credits, targets = credit_references(people), cut(show_targets(shows))
    counts = cut(count_references(credits.where(F.col("show").isNotNull()), ["show", "season"]))
    of_shows = counts.groupBy("show", "period").agg(F.sum("n_refs").alias("n_refs"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    result = lambda df, src, field, status: df.groupBy("period").agg(F.sum("n_refs").alias("n_refs"), F.count_distinct("key").alias("n_keys")).select(F.lit(src).alias("src"), F.lit(field).alias("field"), F.lit(status).alias("status"), "period", "n_refs", "n_keys")
    missing = anti_counts(of_shows, "show", targets, "show").withColumn("key", F.col("show"))
    kept = counts.where(F.col("season").isNotNull()).join(targets, "show")
    lacking = kept.where(~F.array_contains("ordinals", F.col("season"))).withColumn("key", F.col("season").cast("string"))
    aliases = count_references(credits.where(F.col("alias").isNotNull() & ~F.col("has_alias")), ["alias"]).withColumn("key", F.col("alias"))
    games_missing = anti_counts(count_references(game_references(shows), ["ref"]), "ref", games.where(F.col("id").isNotNull()), "id").withColumn("key", F.col("ref"))

    timed = of_shows.join(targets, "show").withColumn("key", F.col("show"))
    removed, late = (F.col("removed") <= F.col("first_at")), (F.col("first") > F.col("last_at"))
    some = (F.col("removed") <= F.col("last_at")) | (F.col("first") > F.col("first_at"))
    whole = timed.where(some).withColumn("status", F.when(removed, "removed").when(late & F.coalesce(F.col("removed") > F.col("last_at"), F.lit(True)), "late"))
    split = whole.where(F.col("status").isNull()).select("show", F.col("period").alias("_period"), "first", "removed")
    single = credits.join(split, "show").where(month("loaded_at").eqNullSafe(F.col("_period")))
    single = single.withColumn("status", F.when(F.col("removed") <= F.col("loaded_at"), "removed").when(F.col("first") > F.col("loaded_at"), "late")).where("status IS NOT NULL")
    both = whole.where(F.col("status").isNotNull()).select("status", "period", "n_refs", "key").unionByName(single.groupBy("status", F.col("_period").alias("period"), F.col("show").alias("key")).agg(F.count(F.lit(1)).alias("n_refs")))
    timely = both.groupBy("status", "period").agg(F.sum("n_refs").alias("n_refs"), F.count_distinct("key").alias("n_keys")).select(F.lit("people").alias("src"), F.lit("show").alias("field"), "status", "period", "n_refs", "n_keys")
    parts = [result(missing, "people", "show", "missing"), result(lacking, "people", "season", "missing"), result(aliases, "people", "alias", "missing"), result(games_missing, "shows", "game", "missing"), timely]
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return counted
