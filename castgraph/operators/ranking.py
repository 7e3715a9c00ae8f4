"""Tails, runners-up, rates, seeded picks and close pairs."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from castgraph.session import cut


def tail(rows: DataFrame, key: str, order: list[str], n: int, at_least: int = 1) -> DataFrame:
    """The last n rows of each key by the order, for keys with at least so many rows, with `place` 1 for the last.

    Spark keeps only n rows of a key in each task before the shuffle (window group limit), so a hot key doesn't travel whole.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    last = rows.withColumn("place", place).where(F.col("place") <= n)
    if at_least <= 1:
        return last
    enough = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= at_least).select(key)
    return last.join(enough, key, "left_semi")


def best_and_runner_up(rows: DataFrame, key: str, score: str) -> DataFrame:
    """(key, best, runner_up, gap) of each key's two greatest scores, with partial maxima; runner_up is null and the gap the best if there is one only."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score)))
    two = rows.select(key, score).withColumn("_p", place).where("_p <= 2").groupBy(key)
    both = two.agg(F.max(F.when(F.col("_p") == 1, F.col(score))).alias("best"), F.max(F.when(F.col("_p") == 2, F.col(score))).alias("runner_up"))
    return both.withColumn("gap", F.col("best") - F.coalesce("runner_up", F.lit(0)))


def trending(rows: DataFrame, key: str, value: str, at: str, as_of: str) -> DataFrame:
    """Mean value and mean of value per day of age; an age is a day at least, and one day where it is unknown."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col(at).cast("timestamp"))
    age = F.greatest(F.lit(1.0), F.coalesce(seconds / 86400.0, F.lit(1.0)))
    return rows.groupBy(key).agg(F.round(F.avg(value), 4).alias("mean_value"), F.round(F.avg(F.col(value) / age), 4).alias("mean_per_day"))


def mulberry32(seed: int) -> Iterator[float]:
    """Draws from [0, 1) by the public 32-bit generator of this name, in the form that carries the mixed state over to the next draw."""
    # The constants of the generator.
    state = (seed + 0x6D2B79F5) & 0xFFFFFFFF
    while True:
        state = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        state ^= (state + (state ^ state >> 7) * (state | 61)) & 0xFFFFFFFF
        yield (state ^ state >> 14) / 0x100000000
    # End of fixed values.


def shuffled(n: int, seed: int) -> array:
    """The numbers 0 to n - 1 in the day's order: the last place is filled first by a draw from all, and so on down."""
    draws, out = mulberry32(seed), array("q", range(n))
    for i in range(n - 1, 0, -1):
        j = int(next(draws) * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """The distinct keys with their number (from 0) in sorted order, by a range-partitioned sort: no task sees more than its range."""
    ranged = cut(rows.select(key).distinct().repartitionByRange(key).select(key, F.spark_partition_id().alias("_part")))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))), "_part").select(key, (F.col("_place") + F.col("_before")).cast("long").alias("number"))


def daily_picks(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """(key, place): the first n of all keys, sorted and then shuffled by the day's seed.

    The shuffle is a sequence of dependent draws, so one task makes it, over numbers only; the keys stay distributed.
    """
    picks = "array<struct<number: bigint, place: int>>"

    @F.pandas_udf(picks)
    def first(sizes: pd.Series) -> pd.Series:
        return sizes.map(lambda size: [{"number": k, "place": p} for p, k in enumerate(shuffled(int(size), seed)[:n], 1)])

    chosen = rows.agg(F.count_distinct(key).alias("size")).select(F.explode(first("size")).alias("_p")).select("_p.*")
    return numbered(rows, key).join(F.broadcast(chosen), "number").select(key, "place")  # n rows


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds `place` over all rows: for listings and top rows, which are few."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def live_trending(rates: DataFrame, shows: DataFrame, seasons: DataFrame, n: int) -> DataFrame:
    """The n highest rates (show_id, season, mean_value, mean_per_day) of shows that exist, with the season if it does."""
    of_seasons = seasons.groupBy(F.col("show").alias("show_id"), F.col("ordinal").alias("season")).agg(F.first("title").alias("season_title"), F.lit(True).alias("_has"))
    met = rates.join(shows.select(F.col("id").alias("show_id"), "title"), "show_id").join(of_seasons, ["show_id", "season"], "left")
    top = met.select(F.col("show_id").alias("show"), "title", F.when(F.col("_has"), F.col("season")).alias("season"), "season_title", "mean_value", "mean_per_day").orderBy(F.desc("mean_per_day"), "show").limit(n)
    return placed(top, [F.desc("mean_per_day"), F.asc("show")])


def random_entity(rows: DataFrame, seed: int) -> DataFrame:
    """One row picked at random, each as likely as another: of a union, a collection is as likely as it is large."""
    return rows.orderBy(F.rand(seed)).limit(1)


def close_pairs(rows: DataFrame, text: str, most: int) -> DataFrame:
    """Pairs of distinct texts within `most` edits.

    By the pigeonhole a text cut into most + 1 segments keeps one of them whole, moved by at most `most` places: texts are joined
    on (length of one, segment number, segment), never all with all.
    """
    lengths = F.sequence(F.greatest(F.length(text) - most, F.lit(0)), F.length(text) + most)
    k = most + 1
    pieces = []
    for i in range(k):
        start = F.floor(F.lit(i) * F.length(text) / k).cast("int")
        end = F.floor(F.lit(i + 1) * F.length(text) / k).cast("int")
        pieces.append(F.struct(F.length(text).alias("n"), F.lit(i).alias("i"), F.substring(F.col(text), start + 1, end - start).alias("s")))
    index = rows.select(F.col(text).alias("b"), F.explode(F.array(*pieces)).alias("p")).select("b", "p.*")

    def probe(n, i: int):
        start, size = F.floor(F.lit(i) * n / k).cast("int"), (F.floor(F.lit(i + 1) * n / k) - F.floor(F.lit(i) * n / k)).cast("int")
        return F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda d: F.when((start + d >= 0) & (start + d + size <= F.length(text)), F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(F.col(text), start + d + 1, size).alias("s"))))

    probes = F.array_distinct(F.array_compact(F.flatten(F.transform(lengths, lambda n: F.flatten(F.array(*[probe(n.cast("int"), i) for i in range(k)]))))))
    asked = rows.select(F.col(text).alias("a"), F.explode(probes).alias("p")).select("a", "p.*")
    met = asked.join(index, ["n", "i", "s"]).where(F.col("a") < F.col("b")).select("a", "b").distinct()
    return met.where(F.levenshtein("a", "b", most) >= 0)
