"""Titles compared by their telling words, with room for typing errors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castgraph.llm.reflist import budget, plain
from castgraph.session import cut, release

#: Least similarity of titles of which one contains the other.
LEAST = 0.5

# Words that tell nothing of a title, and what catalogues and wikis append to one.
WEAK_WORDS = {"the", "a", "an", "and", "of", "in", "at", "on", "from", "to", "el", "la", "le", "o", "der", "die", "das", "tales", "beyond"}
_appended = re.compile(r"\((?:season|series|podcast|tv)[^)]*\)|[:\-–—]\s*(?:the series|an actual play|actual play|the podcast|podcast|season \d+)\s*$|\bpodcast\s*$", re.I)
# End of fixed values.


@lru_cache(maxsize=30_000)
def title_words(title: str) -> tuple[str, ...]:
    """The telling words of a title; all its words if none is telling."""
    text = plain(title.replace("_", " ")).strip()
    for _ in range(3):
        shorter = _appended.sub(" ", text).strip()
        if shorter == text or not shorter:
            break
        text = shorter
    words = re.findall(r"[^\W_]+", text)
    return tuple(w for w in words if w not in WEAK_WORDS) or tuple(words)


def deletions(word: str) -> set[str]:
    """The word and what is left of it without any one letter; two words one edit or swap apart share one."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) >= 5 else {word}


def title_keys(words: dict[str, tuple[int, list[str]]]) -> list[tuple[str, bool]]:
    """Keys of a title, each with whether it is one of the title's rarest word; `words` has of each telling word its count and the more frequent words it fits.

    A key is a pair of words, each as it is or as a word it fits; a lone word is its own key. If the telling words of one title are all in another,
    mistyped or not, then some key of its rarest word is a key of the other.
    """
    forms = {w: (w, *near) for w, (_, near) in words.items()}
    if len(words) == 1:
        return [(f, True) for f in next(iter(forms.values()))]
    rarest = min(words, key=lambda w: (words[w][0], -len(w), w), default=None)
    keys: dict[str, bool] = {}
    for a, b in combinations(sorted(words), 2):
        for x in forms[a]:
            for y in forms[b]:
                k = f"{min(x, y)}|{max(x, y)}"
                keys[k] = keys.get(k, False) or rarest in (a, b)
    return list(keys.items())


@lru_cache(maxsize=50_000)
def swaps_distance(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of neighbours being one; most + 1 if there are more."""
    if a == b:
        return 0
    if not most or abs(len(a) - len(b)) > most or len({*a} ^ {*b}) > 2 * most:  # an edit changes two of the letters at most
        return most + 1
    start, short = 0, min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    end = 0
    while end < short - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    if most == 1:
        return 1 if len(a) == len(b) and (len(a) == 1 or len(a) == 2 and a == b[::-1]) else 2
    above, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if above is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, above[j - 2] + 1)
            new.append(cost)
        above, row = row, new
        if min(row) > most and min(above) > most:
            return most + 1
    return min(row[-1], most + 1)


def similarity(a: str, b: str) -> float:
    """1 for the same telling words; less for typing errors (0.03 each) and for words only one title has; 0 if the shorter isn't contained."""
    one, two = sorted((list(title_words(a)), list(title_words(b))), key=len)
    if not one:
        return 0.0
    left, errors, matched = list(two), 0, 0
    for w in one:
        if w in left:
            left.remove(w)
            matched += 1
            continue
        near = [(d, n) for n, v in enumerate(left) if abs(len(w) - len(v)) <= (most := budget(max(len(w), len(v)))) and most and (d := swaps_distance(w, v, most)) <= most]
        if near:
            d, n = min(near)
            errors += d
            matched += 1
            del left[n]
    if matched < len(one):
        return 0.6 * matched / len(two) if matched >= 2 else 0.0
    return max(0.0, (1.0 if len(one) == len(two) else 0.55 + 0.3 * len(one) / len(two) if len(one) > 1 else 0.35) - 0.03 * errors)


def words(column: Column | str) -> Column:
    """The telling words of a title; none for null."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: list(title_words(t)) if t else [])

    return run(column)


def with_keys(df: DataFrame, column: str, function: Callable) -> DataFrame:
    """A row of `df` for each key of its column, with `key`, a hash, and `flag`; `function` gives a list of (key, flag).

    Keys are written as flat columns batch by batch, which is far cheaper than a list of structs in each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [function(v) for v in batch.column(names.index(column)).to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            flat = [k for f in found for k in f]
            columns = [batch.column(i).take(owner) for i in range(len(kept))] + [pa.array([k for k, _ in flat], pa.string()), pa.array([f for _, f in flat], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "_key", "flag"])

    kept = [c for c in df.columns if c != column] if not isinstance(df.schema[column].dataType, T.StringType) else list(df.columns)
    names = [*kept, *(c for c in [column] if c not in kept)]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("_key", T.StringType()), T.StructField("flag", T.BooleanType())])
    return df.select(*names).mapInArrow(run, schema).withColumn("key", F.xxhash64("_key"))


def similar(a: Column | str, b: Column | str) -> Column:

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([similarity(s, t) if s and t else 0.0 for s, t in zip(x, y)])

    return run(a, b)


def edges(counts: DataFrame, keys: Callable[[str], list[tuple[str, bool]]], fits: Callable[[str, str], bool]) -> DataFrame:
    """(word, near): of each word of `counts` (word, n) the more frequent words it fits, among those it shares a key with.

    Only the vocabulary is compared, not the texts; each pair of words is found from its rarer one.
    """
    keyed = cut(with_keys(counts, "word", keys).select("word", "n", "key"))
    low, high = keyed.select("key", F.struct("n", "word").alias("a")), keyed.select("key", F.struct("n", "word").alias("b"))
    met = low.join(high, "key").where(F.col("a") < F.col("b")).select("a.word", F.col("b.word").alias("other")).distinct()

    @F.pandas_udf("boolean")
    def fit(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([fits(s, t) for s, t in zip(x, y)], dtype="bool")

    found = cut(met.where(fit("word", "other")).groupBy("word").agg(F.collect_list("other").alias("near")))
    release(keyed)
    return found


def fits(a: str, b: str) -> bool:
    most = budget(max(len(a), len(b)))
    return swaps_distance(a, b, most) <= most


def pairs(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(l, r, score) for tables (l, title) and (r, title): pairs of rows of which one title's telling words are all in the other's, with their best similarity.

    The title that is contained is looked up by the pairs of words its rarest word is in, the other by all its pairs of words. So titles that
    merely share frequent words never meet, and the pairs grow with the titles that are alike. Equal titles are compared once.
    """
    a = left.where(F.col("title").isNotNull()).distinct()
    b = right.where(F.col("title").isNotNull()).distinct()
    sides = a.select("title", F.lit(True).alias("ours")).unionByName(b.select("title", F.lit(False).alias("ours"))).groupBy("title").agg(F.bool_or("ours").alias("ours"), F.bool_or(~F.col("ours")).alias("theirs"))
    read = cut(sides.withColumn("words", F.array_distinct(words("title"))))
    single = read.select("title", F.explode("words").alias("word"))
    counts = cut(single.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    near = edges(counts, lambda w: [(d, True) for d in deletions(w)], fits)
    given = single.join(counts, "word").join(near, "word", "left").groupBy("title").agg(F.collect_list(F.concat_ws(" ", "word", F.col("n").cast("string"), "near")).alias("given"))
    split = lambda g: {w: (int(n), rest) for w, n, *rest in map(str.split, g)}
    keyed = with_keys(given.join(read.select("title", "ours", "theirs"), "title"), "given", lambda g: title_keys(split(g)))
    keyed = cut(keyed.select("title", "ours", "theirs", "key", F.col("flag").alias("sole")))
    ka, kb = keyed.where("ours").select("key", F.col("title").alias("lt"), "sole"), keyed.where("theirs").select("key", F.col("title").alias("rt"), "sole")
    both = ka.where("sole").drop("sole").join(kb.drop("sole"), "key").unionByName(ka.where("NOT sole").drop("sole").join(kb.where("sole").drop("sole"), "key"))
    both = both.select("lt", "rt").distinct().withColumn("score", similar("lt", "rt")).where(F.col("score") >= least)
    found = both.join(a.withColumnRenamed("title", "lt"), "lt").join(b.withColumnRenamed("title", "rt"), "rt")
    found = cut(found.groupBy("l", "r").agg(F.max("score").alias("score")))
    release(read, keyed, counts, near)
    return found
