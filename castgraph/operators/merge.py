"""Credits merged without losing evidence: an ordered fold inside each person, and the merging of two persons."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castgraph import model
from castgraph.functions import text
from castgraph.functions.text import ROLE_LABEL

_label = re.compile(ROLE_LABEL.replace("(?i)", ""), re.I)
ADDED, CORROBORATED, CITED = "added", "corroborated", "already-cited"


def real_character(value: str | None) -> str | None:
    value = (value or "").strip()
    return value if value and not _label.match(value) else None


def role_kind(role: str | None) -> str:
    role = role or ""
    return "gm" if "GM" in role or "DM" in role else "player" if "player" in role else role


def _character_words(value: str | None) -> str:
    return " ".join(re.sub("[^a-z0-9 /]", "", (value or "").lower()).split())


def compatible_characters(a: str | None, b: str | None) -> bool:
    """Whether two statements of the character can both be right: one is silent, or some name of one contains one of the other."""
    x, y = _character_words(a), _character_words(b)
    if not x or not y or x in y or y in x:
        return True
    names = [[p.strip() for p in s.split("/") if p.strip()] for s in (x, y)]
    return any(p in q or q in p for p in names[0] for q in names[1])


def _cited(credit: dict, source: dict) -> bool:
    for known in credit["sources"] or []:
        for key in ("url", "attested_by"):
            if known and known.get(key) and source.get(key):
                if known[key] == source[key]:
                    return True
                break
    return False


def _extended(credit: dict, sources: list[dict]) -> dict | None:
    """The credit with the sources it doesn't cite yet; None if there are none."""
    fresh = [s for s in sources or [] if s and not _cited(credit, s)]
    return {**credit, "sources": [*(credit["sources"] or []), *fresh]} if fresh else None


def _at(c: dict) -> tuple:
    return c["show"], c["season"], c["episode"]


def upsert(credits: list[dict], new: dict) -> tuple[str, list[dict]]:
    """Fold one credit into a person's credits; the outcome and the new list. Nothing known is overwritten, no source is lost.

    In this order: bare participation is evidence for another job at the same place; a credit without season is evidence for every
    season's credit it covers; the same fact gets the sources and what it lacked; anything else is added.
    """
    bare = real_character(new["character"]) is None and "player" in (new["role"] or "")
    targets = [i for i, c in enumerate(credits) if bare and _at(c) == _at(new) and "player" not in (c["role"] or "")][:1]
    fill = False
    if not targets and new["season"] is None and new["episode"] is None:
        targets = [i for i, c in enumerate(credits) if c["show"] == new["show"] and c["season"] is not None and _alike(c, new)]
    if not targets:
        targets, fill = [i for i, c in enumerate(credits) if _at(c) == _at(new) and _alike(c, new)][:1], True
    if not targets:
        return ADDED, [*credits, new]
    out, outcome = list(credits), CITED
    for i in targets:
        longer = _extended(out[i], new["sources"])
        if longer:
            outcome = CORROBORATED
            if fill:
                longer |= {k: longer[k] if longer[k] is not None else new[k] for k in ("character", "note")}
            out[i] = longer
    return outcome, out


def _alike(a: dict, b: dict) -> bool:
    return role_kind(a["role"]) == role_kind(b["role"]) and compatible_characters(a["character"], b["character"])


def _specificity(credit: dict) -> int:
    return 0 if credit["episode"] is not None else 1 if credit["season"] is not None else 2


def deduplicated(credits: list[dict]) -> list[dict]:
    """The credits folded into each other, the most specific first, otherwise in their order."""
    out: list[dict] = []
    for credit in sorted((c for c in credits if c is not None), key=_specificity):
        out = upsert(out, credit)[1]
    return out


_CREDITS = T.ArrayType(model.CREDIT)


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "tolist") or isinstance(value, list):
        return [_plain(v) for v in (value.tolist() if hasattr(value, "tolist") else value)]
    return None if isinstance(value, float) and value != value else value


def deduplicate(people: DataFrame) -> DataFrame:
    """`credits` folded within each record. A record holds its own credits, so nothing is shuffled."""

    @F.pandas_udf(_CREDITS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda c: None if c is None else _ints(deduplicated(_plain(c))))

    return people.withColumn("credits", run("credits"))


def _ints(credits: list[dict]) -> list[dict]:
    return [{**c, "season": None if c["season"] is None else int(c["season"])} for c in credits]


def upsert_batch(people: DataFrame, incoming: DataFrame) -> DataFrame:
    """People with a batch of credits (id, seq, credit) folded in, in order of seq.

    The batch is first put together per person, so the fold runs on one row a person; a person's credits are bounded by what a
    record holds.
    """
    batch = incoming.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "credit"))), lambda x: x["credit"]).alias("_new"))

    @F.pandas_udf(_CREDITS)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for old, new in parts:
            out = []
            for a, b in zip(old, new):
                credits = [c for c in (_plain(a) if a is not None else []) if c is not None]
                for credit in _plain(b) if b is not None else []:
                    credits = upsert(credits, credit)[1]
                out.append(_ints(credits))
            yield pd.Series(out)

    joined = people.join(batch, "id", "left")
    touched = joined.where("_new IS NOT NULL").withColumn("credits", run("credits", "_new")).drop("_new")
    return joined.where("_new IS NULL").drop("_new").unionByName(touched)


def merged_person(winner: dict, loser: dict) -> dict:
    """Two records as one: the losing names become aliases, credits are folded with all their sources, dangling alias ids go."""
    names, aliases = set(), []
    for alias in [*(winner["aliases"] or []), *(loser["aliases"] or []), {"id": loser["id"], "name": loser["canonical_name"], "alias_type": "stage", "active_from": None, "active_to": None, "note": None}]:
        if alias and alias["name"] and alias["name"].lower() not in names:
            names.add(alias["name"].lower())
            aliases.append(alias)
    ids, credits = {a["id"] for a in aliases}, [c for c in winner["credits"] or [] if c]
    for credit in loser["credits"] or []:
        if credit:
            credits = upsert(credits, {**credit, "alias": credit["alias"] if credit["alias"] in ids else None})[1]
    return {**loser, **{k: v for k, v in winner.items() if v is not None}, "aliases": aliases, "credits": credits}


def choices(people: DataFrame, pairs: DataFrame) -> DataFrame:
    """(root, loser, seq): who is merged into whom, by pairs (a, b) of the same last name taken in order of their ids.

    Of a pair the one with more credits wins, then the one with the longer name, then b; who lost takes part in no further pair. `root` is whom a
    loser ends in. The pairs of one last name are decided together, for nobody is paired outside of it.
    """
    last = F.element_at(F.split(text.name_key("canonical_name"), " "), -1)
    about = people.select("id", last.alias("block"), F.greatest(F.coalesce(F.size("credits"), F.lit(0)), F.lit(0)).alias("n"), F.coalesce(F.length("canonical_name"), F.lit(0)).alias("m"))
    both = pairs.join(about.toDF("a", "block", "an", "am"), "a").join(about.select("id", "n", "m").toDF("b", "bn", "bm"), "b")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        parent, rows = {}, []
        for p in pdf.sort_values(["a", "b"]).itertuples():
            if p.a in parent or p.b in parent:
                continue
            winner, loser = (p.a, p.b) if (p.an, p.am) > (p.bn, p.bm) else (p.b, p.a)
            parent[loser] = winner
            rows.append(loser)
        out = []
        for seq, loser in enumerate(rows):
            root = parent[loser]
            while root in parent:
                root = parent[root]
            out.append((root, loser, seq))
        return pd.DataFrame(out, columns=["root", "loser", "seq"])

    return both.groupBy("block").applyInPandas(decide, "root string, loser string, seq int")


def merge_people(people: DataFrame, chosen: DataFrame) -> DataFrame:
    """The records (PERSON fields) of everybody somebody was merged into: losing names become aliases, credits are folded with all their sources."""
    order = chosen.select(F.col("loser").alias("id"), "root", "seq").unionByName(chosen.select(F.col("root").alias("id"), "root", F.lit(-1).alias("seq")).distinct())
    told = people.select("id", F.to_json(F.struct(*model.PERSON.names), {"ignoreNullFields": "false"}).alias("_json")).join(order, "id")
    grouped = told.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "_json"))), lambda x: x["_json"]).alias("_all"))

    @F.pandas_udf("string")
    def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for records in part:
                winner, *losers = map(json.loads, records)
                for loser in losers:
                    winner = merged_person(winner, loser)
                out.append(json.dumps(winner))
            yield pd.Series(out)

    return grouped.select(F.from_json(fold("_all"), model.PERSON).alias("_p")).select("_p.*")
