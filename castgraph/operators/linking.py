"""Titles joined by containment or nearness, and playlists assigned to seasons, without comparing all with all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph.functions import filters

#: Lengths of the substrings by which a contained title is looked up, the longest that it has.
GRAMS = (18, 12, 6, 3, 1)
#: Edits two titles may differ by.
EDITS = 2
# Bounds of a playlist's length against a season's, the length from which an unmeasured playlist needs its exact title, the gap below which two fit equally well.
LEAST_RATIO, MOST_RATIO, UNMEASURED, CLEAR_GAP = 0.5, 2.2, 20, 0.5
# End of fixed values.


def _own_size(key: Column) -> Column:
    """The longest of the sizes that a title has."""
    return F.coalesce(*[F.when(F.length(key) >= n, F.lit(n)) for n in GRAMS])


def _own(key: Column) -> Column:
    """The number of what a title looks for in those that contain it: its first substring of its own size."""
    return F.xxhash64(_own_size(key), F.substr(key, F.lit(1), _own_size(key)))


def _all(key: Column, sizes: Column) -> Column:
    """The numbers of all substrings of those sizes that are looked up. Numbers are made distinct in one pass, structs by comparing each with all."""
    of = lambda n: F.when((F.length(key) >= n) & F.array_contains(sizes, n), F.transform(F.sequence(F.lit(1), F.length(key) - n + 1), lambda i: F.xxhash64(F.lit(n), F.substr(key, i, F.lit(n)))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[of(n) for n in GRAMS]))))


def _segments(key: Column) -> Column:
    """The numbers of (length, number, segment) of a title cut into EDITS + 1 parts: of two titles at most so many edits apart, one keeps a part of the other whole."""
    k = EDITS + 1
    part = lambda i: F.substr(key, F.floor(F.length(key) * i / k).cast("int") + 1, (F.floor(F.length(key) * (i + 1) / k) - F.floor(F.length(key) * i / k)).cast("int"))
    return F.array(*[F.xxhash64(F.length(key), F.lit(i), part(i)) for i in range(k)])


def _probes(key: Column) -> Column:
    """The numbers of the places of a title where a part of one of nearly its length may lie."""
    k = EDITS + 1

    def of(n: Column, i: int) -> Column:
        start, size = F.floor(n * i / k).cast("int"), (F.floor(n * (i + 1) / k) - F.floor(n * i / k)).cast("int")
        return F.transform(F.sequence(F.lit(-EDITS), F.lit(EDITS)), lambda d: F.when((start + d >= 0) & (start + d + size <= F.length(key)), F.xxhash64(n, F.lit(i), F.substr(key, start + d + 1, size))))

    lengths = F.sequence(F.greatest(F.length(key) - EDITS, F.lit(1)), F.length(key) + EDITS)
    return F.array_distinct(F.array_compact(F.flatten(F.transform(lengths, lambda n: F.flatten(F.array(*[of(n.cast("int"), i) for i in range(k)]))))))


def near_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of the distinct titles (`key`) of two tables that are equal, contain one another, or are at most EDITS edits apart; empty titles match nothing.

    A contained title is looked up by a substring of its own among all substrings of the others that are as long; near ones share a segment. Parts
    are joined by one number, and the titles then compared. The planner takes the exploded parts to be as small as the titles, so these joins must
    not be left to it: it would broadcast them through the driver.
    """
    a, b = left.where("key <> ''").select("key").distinct(), right.where("key <> ''").select("key").distinct()

    def inner(small: DataFrame, large: DataFrame, s: str, l: str) -> DataFrame:  # noqa: E741
        sizes = small.agg(F.collect_set(_own_size(F.col("key"))).alias("sizes"))  # one row of as many as GRAMS at most
        parts = large.crossJoin(F.broadcast(sizes)).select(F.col("key").alias(l), F.explode(_all(F.col("key"), F.col("sizes"))).alias("p"))
        return small.select(F.col("key").alias(s), _own(F.col("key")).alias("p")).join(parts.hint("merge"), "p").where(F.contains(l, F.col(s))).select("a", "b")

    probes = a.select(F.col("key").alias("a"), F.explode(_probes(F.col("key"))).alias("p"))
    segments = b.select(F.col("key").alias("b"), F.explode(_segments(F.col("key"))).alias("p"))
    near = probes.hint("merge").join(segments, "p").where(F.levenshtein("a", "b", EDITS) >= 0).select("a", "b")
    return inner(a, b, "a", "b").unionByName(inner(b, a, "b", "a")).unionByName(near).distinct()


def near_titles(left: DataFrame, left_id: str, right: DataFrame, right_id: str) -> DataFrame:
    """(left_id, right_id) of titles (`key`) that are equal, contain one another, or are nearly equal, as `near_keys` has it."""
    met = near_keys(left, right).join(left.select(F.col(left_id), F.col("key").alias("a")).hint("merge"), "a")
    return met.join(right.select(F.col(right_id), F.col("key").alias("b")).hint("merge"), "b").select(left_id, right_id)


def first_near(left: DataFrame, left_id: str, right: DataFrame, right_id: str) -> DataFrame:
    """(left_id, right_id): of each of `left` that has any, the least of those that `near_titles` gives, null if they are. Titles that many have are matched once, not id by id."""
    first = right.groupBy(F.col("key").alias("b")).agg(F.min(right_id).alias(right_id))
    of_key = near_keys(left, right).join(first.hint("merge"), "b").groupBy("a").agg(F.min(right_id).alias(right_id))
    return left.select(F.col(left_id), F.col("key").alias("a")).join(of_key.hint("merge"), "a").groupBy(left_id).agg(F.min(right_id).alias(right_id))


def season_playlists(seasons: DataFrame, playlists: DataFrame, games: DataFrame) -> DataFrame:
    """(show, ordinal, playlist, score) of the playlist each season with a title is, at most one season a playlist.

    `seasons` has (show, show_title, ordinal, title, episode_count, taken), `playlists` (show, playlist, title, n). Titles are compared without the
    show's own and must contain one another; lengths may differ within bounds; an exact title beats all. A season of which two playlists fit
    equally well, and one whose playlist an earlier season has, is left alone. Only the seasons of one show meet in one task.
    """
    bare = lambda c: F.trim(F.regexp_replace(F.replace(filters.season_title(c), filters.season_title("show_title"), F.lit(" ")), " +", " "))
    systems = games.select(filters.season_title("name").alias("key")).where("key <> ''").distinct()
    wanted = seasons.where("title IS NOT NULL").select("show", "show_title", "ordinal", "episode_count", bare("title").alias("key")).where(F.length("key") >= 3).join(systems, "key", "left_anti")
    offered = playlists.join(seasons.select("show", "show_title").distinct(), "show").select("show", "playlist", "n", bare("title").alias("p_key")).where(F.length("p_key") >= 3)
    met = wanted.join(offered, "show").where(F.contains("p_key", F.col("key")) | F.contains("key", F.col("p_key")))
    ratio = F.col("n") / F.col("episode_count")
    measured = F.col("episode_count") > 0
    met = met.where(F.when(measured, ratio.between(LEAST_RATIO, MOST_RATIO)).otherwise((F.col("n") <= UNMEASURED) | (F.col("p_key") == F.col("key"))))
    score = F.when(F.col("p_key") == F.col("key"), 1000.0).otherwise(0.0) - F.abs(F.length("p_key") - F.length("key")) - F.when(measured, F.abs(F.col("n") - F.col("episode_count")) / 100.0).otherwise(0.0)
    met = met.select("show", "ordinal", "playlist", score.alias("score"))
    known = seasons.where("taken IS NOT NULL").select("show", "ordinal", F.col("taken").alias("playlist"), F.lit(None).cast("double").alias("score"))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, rows = set(pdf[pdf.score.isna()].playlist), []
        for ordinal, some in pdf[pdf.score.notna()].groupby("ordinal", sort=True):
            best = some.sort_values(["score", "playlist"], ascending=[False, True])
            clear = len(best) == 1 or best.score.iloc[0] - best.score.iloc[1] >= CLEAR_GAP
            if clear and best.playlist.iloc[0] not in taken:
                taken.add(best.playlist.iloc[0])
                rows.append((best.show.iloc[0], ordinal, best.playlist.iloc[0], best.score.iloc[0]))
        return pd.DataFrame(rows, columns=["show", "ordinal", "playlist", "score"])

    return met.unionByName(known).groupBy("show").applyInPandas(assign, "show string, ordinal int, playlist string, score double")


def with_playlists(shows: DataFrame, assigned: DataFrame, prefix: str) -> DataFrame:
    """Shows with the assigned playlists written into their seasons' links; other links stay."""
    links = assigned.groupBy(F.col("show").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("ordinal", "playlist"))).alias("_p"))
    told = lambda s: s.withField("links", F.coalesce(s["links"], F.from_json(F.lit("{}"), "struct<website:string,wikipedia:string,youtube:string,podcast:string,forum:string,bluesky:string,mastodon:string,twitch:string>")).withField("website", F.concat(F.lit(prefix), F.col("_p")[s["ordinal"]])))
    changed = F.transform("seasons", lambda s: F.when(F.col("_p")[s["ordinal"]].isNotNull(), told(s)).otherwise(s))
    return shows.join(links, "id", "left").withColumn("seasons", F.when(F.col("_p").isNull(), F.col("seasons")).otherwise(changed)).drop("_p")
