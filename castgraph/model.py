"""Declared schemas, enumerations and orders of the data model. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _ints(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.IntegerType()) if f.name in names else f for f in schema.fields])


LINKS = _strings("website", "wikipedia", "youtube", "podcast", "forum", "bluesky", "mastodon", "twitch")
IMAGE = _strings("url", "licence", "attribution", "source", "rationale", "depicts")
SOURCE = _strings("url", "note", "tier", "attested_by", "locator")
ALIAS = _strings("id", "name", "alias_type", "active_from", "active_to", "note")
CREDIT_FLAT = _ints(_strings("show", "season", "episode", "role", "character", "alias", "year", "note"), "season")
CREDIT = T.StructType([*CREDIT_FLAT.fields, T.StructField("sources", T.ArrayType(SOURCE))])
SEASON = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("game", T.ArrayType(T.StringType())),
        T.StructField("started", T.StringType()),
        T.StructField("ended", T.StringType()),
        T.StructField("episode_count", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("links", LINKS),
        T.StructField("image", IMAGE),
    ]
)
PERSON = T.StructType(
    [
        *_strings("id", "canonical_name", "sort_name", "pronouns", "bio", "wikidata_qid").fields,
        T.StructField("links", LINKS),
        T.StructField("image", IMAGE),
        T.StructField("aliases", T.ArrayType(ALIAS)),
        T.StructField("credits", T.ArrayType(CREDIT)),
    ]
)
SHOW = T.StructType(
    [
        *_strings("id", "title", "sort_title").fields,
        T.StructField("channels", T.ArrayType(T.StringType())),
        T.StructField("format", T.StringType()),
        T.StructField("solo", T.BooleanType()),
        *_strings("status", "description").fields,
        T.StructField("links", LINKS),
        T.StructField("image", IMAGE),
        T.StructField("seasons", T.ArrayType(SEASON)),
    ]
)
CHANNEL = T.StructType([*_strings("id", "name", "type", "description").fields, T.StructField("links", LINKS), T.StructField("image", IMAGE)])
GAME = T.StructType([*_strings("id", "name", "edition", "publisher").fields, T.StructField("links", LINKS), T.StructField("gm_less", T.BooleanType())])
COLLECTIONS = {"people": PERSON, "shows": SHOW, "channels": CHANNEL, "games": GAME}

# The domains of the enumerated fields, in their semantic order where they have one.
TIERS = ["official", "recording", "participant", "firsthand", "reference", "community"]
DEFAULT_TIER = "reference"
CREDIT_ROLES = ["GM/DM", "player", "guest GM", "guest player", "host", "producer", "editor", "composer", "writer", "director"]
ALIAS_TYPES = ["birth", "maiden", "stage", "handle", "legal"]
CHANNEL_TYPES = ["network", "indie studio", "solo creator"]
FORMATS = ["podcast", "video", "stream", "hybrid"]
STATUSES = ["ongoing", "completed", "hiatus", "cancelled", "unknown"]
LINK_KINDS = ["watch", "listen", "home", "read"]
# End of fixed values.
