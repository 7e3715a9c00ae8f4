"""The flat relations behind every view: current records, credits, aliases, seasons, and credits resolved against all they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph import model
from castgraph.functions import text


def current(records: DataFrame) -> DataFrame:
    """The latest record of each id (of equals the greatest rec_no). One small aggregate row per id is shuffled, not the records."""
    last = records.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("loaded_at", "rec_no")).alias("_last")).select(F.col("_last.rec_no").alias("rec_no"))
    return records.join(last, "rec_no", "left_semi")


def _flat(records: DataFrame, array: str, owner: str, keep: list[str]) -> DataFrame:
    rows = records.select(F.col("id").alias(owner), *keep, F.posexplode(array).alias("pos", "_e"))
    return rows.where(F.col("_e").isNotNull()).select(owner, *keep, "pos", "_e.*")


def credits(people: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per credit with its person, position, and derived provenance; `keep` has further columns of the record."""
    return with_provenance(_flat(people, "credits", "person", ["rec_no", *(keep or [])]))


def aliases(people: DataFrame) -> DataFrame:
    return _flat(people, "aliases", "person", ["rec_no"]).withColumnRenamed("id", "alias_id")


def seasons(shows: DataFrame) -> DataFrame:
    return _flat(shows, "seasons", "show", ["rec_no"]).withColumnRenamed("rec_no", "show_rec")


def tier_rank(tier: Column) -> Column:
    """1 for the strongest tier; a null tier is the default, an unknown one comes last."""
    position = F.array_position(F.array(*map(F.lit, model.TIERS)), F.coalesce(tier, F.lit(model.DEFAULT_TIER)))
    return F.when(position == 0, len(model.TIERS) + 1).otherwise(position)


def with_provenance(credits: DataFrame) -> DataFrame:
    """Adds n_origins (independent origins), status and best_tier, all by array functions within the row."""
    given = F.coalesce(F.filter("sources", lambda s: s.isNotNull()), F.array().cast(credits.schema["sources"].dataType))
    origins = F.size(F.array_distinct(F.transform(given, text.origin_key)))
    best = F.array_min(F.transform(given, lambda s: tier_rank(s["tier"])))
    return credits.withColumns(
        {
            "n_sources": F.size(given),
            "n_origins": origins,
            "status": F.when(origins >= 2, "corroborated").otherwise("single-source"),
            "best_tier": F.get(F.array(*map(F.lit, model.TIERS)), (best - 1).cast("int")),
        }
    )


def named_in_order(rows: DataFrame, key: list[str], array: str, dim: DataFrame, dim_id: str, dim_name: str, out: str) -> DataFrame:
    """`key` and the names of an array's ids joined with |, in the array's order; ids that don't exist drop out."""
    ids = rows.select(*key, F.posexplode(array).alias("_pos", "_id"))
    found = ids.join(dim.select(F.col(dim_id).alias("_id"), F.col(dim_name).alias("_name")), "_id")
    ordered = found.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_name"))).alias("_names"))
    return ordered.select(*key, F.array_join(F.transform("_names", lambda n: n["_name"]), "|").alias(out))


def resolved_credits(people: DataFrame, shows: DataFrame, channels: DataFrame, games: DataFrame) -> DataFrame:
    """Each credit of current people whose show exists, with show, season, games, channels and the billed name.

    Seasons match by (show, ordinal), a null season matches none. The billed name is that of the person's own alias.
    """
    now_people, now_shows = current(people), current(shows)
    base = credits(now_people, ["canonical_name", "aliases"])
    billed = F.filter("aliases", lambda a: a["id"] == F.col("alias"))
    base = base.withColumn("billed", F.get(F.transform(billed, lambda a: a["name"]), F.lit(0))).drop("aliases")
    of_seasons = seasons(now_shows)
    channel_names = named_in_order(now_shows.select(F.col("id").alias("show"), "channels"), ["show"], "channels", channels, "id", "name", "channels")
    game_names = named_in_order(of_seasons.select("show", "ordinal", "game"), ["show", "ordinal"], "game", games, "id", "name", "games")
    known = now_shows.select(F.col("id").alias("show"), F.col("title").alias("show_title")).join(channel_names, "show", "left")
    season = of_seasons.select("show", F.col("ordinal").alias("season"), F.col("title").alias("season_title"), "started").join(game_names.withColumnRenamed("ordinal", "season"), ["show", "season"], "left")
    season = season.groupBy("show", "season").agg(F.first("season_title").alias("season_title"), F.min("started").alias("started"), F.first("games").alias("games"))
    return base.join(known, "show").join(season, ["show", "season"], "left")


def filmography(resolved: DataFrame) -> DataFrame:
    """One row per person and show: credits, roles, earliest and latest year as strings; dated groups first, the latest first."""
    year = F.coalesce("year", "started")
    groups = resolved.groupBy("person", "show", "show_title").agg(
        F.count(F.lit(1)).alias("n_credits"), F.min(year).alias("earliest"), F.max(year).alias("latest"), F.sum((F.col("status") == "corroborated").cast("int")).alias("n_corroborated"), F.array_join(F.array_sort(F.collect_set("role")), "|").alias("roles")
    )
    return groups.withColumn("years", text.year_range("earliest", "latest"))
