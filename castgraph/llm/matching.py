"""Entities of two sources matched without a common key, by belief propagation over candidate pairs.

Candidates share title keys. Each pair gets prior log-odds from title, year, kind and cast. Factors couple the pairs: a foreign title
is at most one show, and a show is rarely many titles. Factors and pairs exchange messages through joins until they settle; the
marginal probability of each pair is its confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph.llm import names, titles
from castgraph.session import cut, release

#: Weight of each further match of a title, and of a show: 0 forbids it, 1 is indifferent.
REPEAT_TITLE, REPEAT_SHOW = 1e-4, 0.5
#: What the cast can add to the prior log-odds at most.
CAST_MOST = 5.0
#: The change of any message at which rounds stop, and the rounds after which messages that still change are an error.
ROUNDS, SETTLED = 200, 1e-3
#: The share of its old value a message keeps in a round; if messages have not settled after so many rounds, they keep half.
DAMPING, CALM_ROUNDS = 0.2, 30
CONFIDENT = 0.5
# The catalogue's kinds of series.
SERIES = ["tvSeries", "tvMiniSeries", "podcastSeries", "webSeries"]
# End of fixed values.


def _known(column: str) -> Column:
    return F.when((F.col(column) != "\\N") & (F.col(column) != ""), F.col(column))


def candidates(shows: DataFrame, basics: DataFrame) -> DataFrame:
    """(show_id, tconst, title_score): pairs of which one title's telling words are all in the other's."""
    ours = shows.where(F.col("id").isNotNull()).select(F.col("id").alias("l"), "title")
    theirs = basics.where(F.col("tconst").isNotNull()).select(F.col("tconst").alias("r"), F.explode(F.array(_known("primaryTitle"), _known("originalTitle"))).alias("title"))
    return titles.pairs(ours, theirs).select(F.col("l").alias("show_id"), F.col("r").alias("tconst"), F.col("score").alias("title_score"))


def person_key(text: str) -> list[str]:
    """Keys of a name in a cast: all its words, all its letters (for swapped ones and other gaps), each longer word up to an edit with the initial of another."""
    name = names.read_name.__wrapped__(text)  # distinct names come once each, so remembering them only takes memory
    if name.handle:
        return ["h:" + p for p in names.handle_prefixes(name.handle)]
    words = [t for t, k in name.tokens if k == "w"]
    if not words:
        return []
    keys = {"n:" + " ".join(sorted(t for t, _ in name.tokens)), "j:" + "".join(sorted(name.joined))}
    for w in words:
        if len(w) >= 4:
            keys |= {f"{d}|{o[0]}" for d in titles.deletions(w) for o, _ in name.tokens if o != w}
    if len(words) > 1:
        keys |= {"h:" + words[0] + words[-1][:3]}
    return sorted(keys)


def cast_overlap(pairs: DataFrame, cast: DataFrame, principals: DataFrame) -> DataFrame:
    """(show_id, tconst, shared, named): how many of a title's people share a name key with the show's cast; people without a name don't count.

    `cast` has (show, name), `principals` (tconst, nconst, name). People of candidate titles are joined with casts by show and key at
    once, so a large cast and a large title are not paired person by person; names of neither take no part.
    """
    casts = cast.join(pairs.select(F.col("show_id").alias("show")).distinct(), "show", "left_semi").select(F.col("show").alias("show_id"), "name")
    theirs = cut(principals.join(pairs.select("show_id", "tconst"), "tconst").where("name IS NOT NULL").select("show_id", "tconst", "nconst", "name"))
    of_names = casts.select("name").unionByName(theirs.select("name")).where("name IS NOT NULL").distinct()
    of_names = cut(titles.with_keys(of_names, "name", lambda text: [(k, True) for k in person_key(text)]).select("name", F.col("key").alias("k")))
    in_show = F.xxhash64("show_id", "k").alias("in_show")  # one number to join by
    ours = casts.join(of_names, "name").select(in_show)
    met = theirs.join(of_names, "name").select("show_id", "tconst", "nconst", in_show).join(ours, "in_show", "left_semi").select("show_id", "tconst", "nconst").distinct()
    shared = met.groupBy("show_id", "tconst").agg(F.count(F.lit(1)).alias("shared"))
    named = theirs.select("tconst", "nconst").distinct().groupBy("tconst").agg(F.count(F.lit(1)).alias("named"))
    counted = cut(pairs.join(shared, ["show_id", "tconst"], "left").join(named, "tconst", "left").fillna(0, ["shared", "named"]))
    release(theirs, of_names)
    return counted


def without_cast(pairs: DataFrame) -> DataFrame:
    """Log-odds from title, year and kind; what is unknown says nothing, but for a year outside those of nearly all shows."""
    score, gap = F.col("title_score"), F.abs(F.col("year") - F.col("our_year"))
    title = F.when(score >= 0.999, 3.0).when(score >= 0.9, 2.5).when(score >= 0.7, 0.5).otherwise(-1.0)
    strange = F.col("our_year").isNull() & ((F.col("year") < F.col("first_years")) | (F.col("year") > F.col("last_years")))
    year = F.when(strange, -3.0).when(gap.isNull(), 0.0).when(gap <= 1, 2.0).when(gap == 2, 0.0).when(gap <= 4, -2.0).otherwise(-4.5)
    series = F.when(F.col("titleType").isNull(), 0.0).when(F.col("titleType").isin(SERIES), 0.5).otherwise(-4.0)
    return pairs.withColumn("log_odds", F.lit(-1.0) + title + year + series)


def with_cast(pairs: DataFrame) -> DataFrame:
    """Prior log-odds: the cast's evidence added."""
    share = F.col("shared") / F.greatest(F.col("named"), F.lit(1))
    cast = F.when(F.col("named") == 0, 0.0).when(F.col("cast_size") == 0, 0.0).when(F.col("shared") == 0, F.greatest(-1.0 * F.col("named"), F.lit(-3.0))).otherwise(F.least(1.0 + 1.5 * F.col("shared"), F.lit(CAST_MOST)) * F.sqrt(share))
    return pairs.withColumn("log_odds", F.col("log_odds") + cast)


def _factor(pairs: DataFrame, key: str, inbound: str, out: str, repeat: float) -> DataFrame:
    """Messages of the factors of one side: with x the odds of the other pairs of the factor, the log ratio of its weight with and without this pair.

    A factor weighs 1 for none or one active pair and `repeat` for each further one, so its sums over the others are
    closed: with P the product of (1 + repeat x), on = P and off = 1 + (P - 1) / repeat. The ratio is taken by 1 / P, which no
    number of strong pairs makes overflow.
    """
    term = F.log1p(F.lit(repeat) * F.exp(F.least(F.col(inbound), F.lit(30.0))))
    sums = pairs.groupBy(key).agg(F.sum(term).alias("_sum"))
    rest = F.greatest(F.col("_sum") - term, F.lit(0.0))
    message = -F.log1p(F.lit(1.0 / repeat - 1.0) * -F.expm1(-rest))
    return pairs.join(sums, key).withColumn(out, message).drop("_sum")


def propagate(pairs: DataFrame, left: str, right: str, repeat_left: float, repeat_right: float, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """The pairs with `confidence`, the marginal probability of each after messages have settled.

    Sums are grouped with partial sums before the shuffle; nothing of a large factor is collected in one task. Messages are damped,
    and each round is written to the shared checkpoint folder, where it replaces the one before. Messages that never settle raise an error.
    """
    state = cut(pairs.withColumns({"to_left": F.lit(0.0), "to_right": F.lit(0.0), "_change": F.lit(0.0)}))
    most = None
    for n in range(rounds):
        keep = DAMPING if n < CALM_ROUNDS else 0.5
        told = state.withColumns({"_in_left": F.col("log_odds") + F.col("to_right"), "_in_right": F.col("log_odds") + F.col("to_left")})
        told = _factor(told, left, "_in_left", "_new_left", repeat_left)
        told = _factor(told, right, "_in_right", "_new_right", repeat_right)
        told = told.withColumns({f"_new_{s}": F.col(f"_new_{s}") * (1 - keep) + F.col(f"to_{s}") * keep for s in ("left", "right")})
        change = F.greatest(F.abs(F.col("_new_left") - F.col("to_left")), F.abs(F.col("_new_right") - F.col("to_right")))
        after = cut(told.withColumns({"_change": change, "to_left": F.col("_new_left"), "to_right": F.col("_new_right")}).select(*state.columns))
        release(state)
        state, most = after, after.agg(F.max("_change")).first()[0]
        if most is None or most < settled:
            break
    else:
        raise RuntimeError(f"messages still change by {most} after {rounds} rounds")
    belief = F.col("log_odds") + F.col("to_left") + F.col("to_right")
    return state.withColumn("confidence", F.lit(1.0) / (F.lit(1.0) + F.exp(-belief))).drop("to_left", "to_right", "_change")


def match_programmes(shows: DataFrame, people: DataFrame, basics: DataFrame, principals: DataFrame, name_basics: DataFrame) -> DataFrame:
    """(show_id, tconst, confidence) of every candidate pair of our shows and the catalogue's titles.

    Messages only lower a belief and the cast adds CAST_MOST at most, so a pair whose log-odds without cast are at most -CAST_MOST never becomes
    probable: it is settled by them, takes part in no factor, and its people are not looked at (`shared` and `named` are null).

    Unknown values (`\\N`, null, empty, no number) are no evidence; repeated rows change nothing; null ids take no part; empty
    tables give no pair. A show's year is that of its first season with a start.
    """
    found = candidates(shows, basics)
    seasons = shows.select("id", F.explode("seasons").alias("s")).where("s IS NOT NULL")
    years = cut(seasons.groupBy(F.col("id").alias("show_id")).agg(F.min_by(F.expr("try_cast(substr(s.started, 1, 4) AS int)"), F.when(F.col("s.started").isNotNull(), F.col("s.ordinal"))).alias("our_year")))
    facts = basics.groupBy("tconst").agg(F.max(F.expr("try_cast(startYear AS int)")).alias("year"), F.max(_known("titleType")).alias("titleType"))
    span = years.agg(F.percentile_approx("our_year", 0.01).alias("first_years"), F.percentile_approx("our_year", 0.99).alias("last_years"))
    judged = found.join(facts, "tconst").join(years, "show_id", "left").crossJoin(F.broadcast(span))  # one row
    judged = cut(without_cast(judged))
    release(found, years)
    settled, pairs = judged.where(F.col("log_odds") <= -CAST_MOST), judged.where(F.col("log_odds") > -CAST_MOST)
    in_shows = names.known_shows(names.person_shows(people), shows)
    cast = cut(names.person_spellings(people).join(in_shows, "id").select("show", "name").distinct())
    ids = principals.select("tconst", "nconst").distinct().join(pairs.select("tconst").distinct(), "tconst", "left_semi")
    known = names.consistent(name_basics.select("nconst", F.col("primaryName").alias("name")).where("name IS NOT NULL AND name <> '\\\\N'").join(ids.select("nconst").distinct(), "nconst", "left_semi").distinct(), "name")
    told = cast_overlap(pairs, cast, ids.join(known, "nconst"))
    sizes = cast.groupBy(F.col("show").alias("show_id")).agg(F.count(F.lit(1)).alias("cast_size"))
    told = with_cast(told.join(sizes, "show_id", "left").fillna(0, ["cast_size"]))
    believed = propagate(told, "tconst", "show_id", REPEAT_TITLE, REPEAT_SHOW)
    release(cast)
    alone = settled.withColumns({"confidence": F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_odds")))})
    columns = ["show_id", "tconst", "confidence", "title_score", "year", "our_year", "titleType", "shared", "named", "cast_size", "log_odds"]
    return believed.unionByName(alone, allowMissingColumns=True).select(*columns)


def matches(pairs: DataFrame, least: float = CONFIDENT) -> DataFrame:
    return pairs.where(F.col("confidence") >= least)
