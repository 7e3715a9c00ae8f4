"""The best value of each field among the records of one person, in a single aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph import model


@dataclass(frozen=True)
class Field:
    """A surviving field: its name, its value, and when that value is usable."""

    name: str
    value: Column
    usable: Column


def survive(records: DataFrame, group: str, record: str, fields: list[Field], strength: Column, at: str) -> DataFrame:
    """One row per group: for each field `<name>` the surviving value and `<name>_rec` the record that gives it.

    One aggregation takes, for each field, the maximum of the struct (usable, strength, time, record negated, value): records
    without a usable value never win, then the greatest strength, the latest time, the least record number. Null time comes last.
    Values and records are null where no record is usable. Partial maxima are taken before the shuffle, so a group that holds a
    third of all rows costs one row per task.
    """
    best = [
        F.max(F.when(f.usable, F.struct(strength.alias("strength"), F.col(at).alias("at"), (-F.col(record)).alias("order"), f.value.alias("value")))).alias(f.name)
        for f in fields
    ]
    rows = records.groupBy(group).agg(F.count(F.lit(1)).alias("n_records"), *best)
    chosen = [c for f in fields for c in (F.col(f"{f.name}.value").alias(f.name), (-F.col(f"{f.name}.order")).alias(f"{f.name}_rec"))]
    return rows.select(group, "n_records", *chosen)


def source_strength(credits: Column | str) -> Column:
    """Strength of the strongest tier of any source: the number of tiers for the first, 0 without any source; a null tier is the default."""
    tiers = F.flatten(F.transform(F.coalesce(F.col(credits) if isinstance(credits, str) else credits, F.array()), lambda c: F.coalesce(F.transform(F.filter(c["sources"], lambda s: s.isNotNull()), lambda s: F.coalesce(s["tier"], F.lit(model.DEFAULT_TIER))), F.array().cast("array<string>"))))
    order = F.array(*[F.lit(t) for t in model.TIERS])
    ranks = F.transform(tiers, lambda t: F.array_position(order, t))
    return F.coalesce(F.lit(len(model.TIERS) + 1) - F.array_min(F.filter(ranks, lambda r: r > 0)), F.lit(0))


def best_representatives(people: DataFrame, groups: DataFrame) -> DataFrame:
    """(group_id, name, name_rec, qid, qid_rec, image, image_rec) of each person with two or more people rows.

    `groups` has (id, root) of ids that are one person; other ids are persons by themselves. group_id is the least id. Rows with a
    null id take no part. A blank name, an identifier other than Q and digits and an image without a url are not usable; the
    surviving record is null where no row is usable.
    """
    rows = people.where(F.col("id").isNotNull()).join(groups, "id", "left").withColumn("group_id", F.coalesce("root", "id"))
    rows = rows.select("group_id", "rec_no", "loaded_at", "canonical_name", "wikidata_qid", "image", source_strength("credits").alias("strength"))
    fields = [
        Field("name", F.col("canonical_name"), F.regexp_replace("canonical_name", r"[\s\p{Z}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{AD}]+", "") != ""),
        Field("qid", F.col("wikidata_qid"), F.col("wikidata_qid").rlike(r"\AQ[0-9]+\z")),
        Field("image", F.col("image"), F.col("image.url").isNotNull()),
    ]
    return survive(rows, "group_id", "rec_no", fields, F.col("strength"), "loaded_at").where("n_records > 1").drop("n_records")
