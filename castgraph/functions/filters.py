"""What counts as a name, a character, a campaign, a licence: ordered tables of patterns, read as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from castgraph.functions import text


@dataclass(frozen=True)
class Shape:
    """What a text must be: its length, how many words it has at most, a pattern it never and one it always has; `outer` is trimmed first."""

    least: int
    most: int
    words: int
    never: str
    always: str = ""
    outer: str = ""


# The shapes of names each kind of source is read by, of characters, and what is a job or an address instead.
NAME_SHAPES = {
    "description": Shape(1, 45, 4, r"[@()\[\]|/\\]|(?i:https?:)|(?i:\b(takes|plays|joins|presents|with|and|the|for|from)\b)", r"^[\p{L}\"'][\p{L}\s.\"'-]*$"),
    "page": Shape(2, 42, 4, r"[@()\[\]|/\\<>]|(?i:https?:)|(?i:\b(the|and|with|for|from|our|your|this|that|all|new|more|home|about|contact|episode|season|patreon|subscribe|support)\b)",
                  r"^\p{Lu}[\p{L}.'-]*(?:\s+\p{Lu}[\p{L}.'-]*){0,3}$|^\p{Ll}[\p{L}\d._-]{2,20}$", r"^[-–—*•\s]+|[\s.,;:]+$"),
    "archive": Shape(1, 40, 4, r"[@|]|(?i:https?:)"),
    "catalogue": Shape(2, 42, 5, r"[<>@|]|(?i:https?:)"),
    "notes": Shape(1, 42, 9, r"(?i:\b(join|us|we|our|you|your|tune|watch|listen|subscribe|this|that|these|with|and|the|for|from|all|new|every|live|available)\b)", r"^\p{L}[\p{L}.'’-]*(?:\s+\p{L}[\p{L}.'’-]*){0,3}$"),
}
CHARACTER_SHAPE = Shape(1, 60, 8, r"[@|]|(?i:https?:)|(?i:\bwww\.)")
ADDRESS = r"(?i)^@|^https?:|^www\.|\.(com|net|org|io|tv|co\.uk)\b"
JOB = (
    r"(?i)^(artist|editor|producer|director|writer|composer|music|sound|art|graphics|design(er)?|animator|host|moderator|mod|crew|staff|team|cast|gamemaster|game ?master|dungeon ?master|storyteller|keeper"
    r"|gm|dm|player|guest)$"
)
CATEGORY_KINDS = [
    ("character", r"(?i)\b(characters?|npcs?|player characters?|creatures?|monsters?)\b"),
    ("person", r"(?i)\b(cast|crew|voice actors?|actors?|dungeon masters?|game masters?|guests?|players?|people|writers?|producers?|editors?|authors?|composers?|hosts?)\b"),
    ("organisation", r"(?i)\b(compan(y|ies)|networks?|studios?|publishers?|organisations?|organizations?)\b"),
]
CAMPAIGN = r"(?i)(campaign|chapter|season|arc|adventure|episode|one[- ]shot|series|play)"
NO_CAMPAIGN = (
    r"(?i)(clip|short|highlight|trailer|promo|recap|behind the scenes|announce|q&a|interview|unboxing|review|how to|tutorial|tips|member|vlog|news|preview|reaction|compilation|best of|soundtrack|music|advice"
    r"|discussion|talk|podcast$|stream vod|full vod|character creation|session zero|one page|rules)"
)
FREE_LICENCES = {"cc0": "CC0", "cc0 1.0": "CC0", "cc by 2.0": "CC-BY-2.0", "cc by 3.0": "CC-BY-3.0", "cc by 4.0": "CC-BY-4.0", "cc by-sa 2.0": "CC-BY-SA-2.0", "cc by-sa 3.0": "CC-BY-SA-3.0", "cc by-sa 4.0": "CC-BY-SA-4.0", "public domain": "public domain", "pd": "public domain"}
OPEN_LICENCES = {"cc0-1.0": "CC0", "pdm-1.0": "public domain", "by-2.0": "CC-BY-2.0", "by-3.0": "CC-BY-3.0", "by-4.0": "CC-BY-4.0", "by-sa-2.0": "CC-BY-SA-2.0", "by-sa-3.0": "CC-BY-SA-3.0", "by-sa-4.0": "CC-BY-SA-4.0"}
HOSTED = r"(?i)\b(?:hosted by|hosts?:|created by|presented by|starring)\s+([^.!?\n]{3,120})"
RUNS_THE_GAME = r"(?i)\b(dungeon|game)\s*master\b|\b(gm|dm)\b|\bkeeper\b|\bstoryteller\b|\bnarrator\b"
NUMBER_WORDS = {"one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}
#: Words that a title is compared without, by what it is compared for.
GENERIC_WORDS = {
    "gap": r"\b(season|campaign|chapter|arc|part)\b",
    "season": r"\b(season|campaign|part|series|chapter|arc|full|complete|playlist|episodes?)\b",
    "feed": r"\b(a|an|the|actual play|an? a5e|level up advanced 5th edition|5e|podcast|series)\b",
    "programme": "",
}
# End of fixed values.

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java(pattern: str) -> str:
    """The pattern with word edges between ASCII letters and digits only, as in its original dialect."""
    return pattern.replace(r"\b", _EDGE)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def has_shape(c: Column | str, shape: Shape) -> Column:
    """Whether a text has the shape; false for null and blank."""
    value = text.trim(c)
    if shape.outer:
        value = F.regexp_replace(value, shape.outer, "")
    fits = (value != "") & F.length(value).between(shape.least, shape.most) & (F.size(F.split(value, r"\s+")) <= shape.words) & ~value.rlike(java(shape.never))
    return F.coalesce(fits & value.rlike(shape.always) if shape.always else fits, F.lit(False))


def looks_like_name(c: Column | str, source: str) -> Column:
    return has_shape(c, NAME_SHAPES[source])


def looks_like_character(c: Column | str) -> Column:
    return has_shape(c, CHARACTER_SHAPE) & ~text.trim(c).rlike(java(ADDRESS))


def is_job(c: Column | str) -> Column:
    return F.coalesce(text.trim(c).rlike(JOB), F.lit(False))


def entity_kind(categories: Column | str) -> Column:
    """character, person or organisation by the first signal any category of an array has; else unknown."""
    signs = [F.when(F.exists(_col(categories), lambda c: c.rlike(java(p))), F.lit(kind)) for kind, p in CATEGORY_KINDS]
    return F.coalesce(*signs, F.lit("unknown"))


def is_campaign(title: Column | str) -> Column:
    return F.coalesce(_col(title).rlike(CAMPAIGN) & ~_col(title).rlike(NO_CAMPAIGN), F.lit(False))


def _looked_up(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])


def free_licence(c: Column | str) -> Column:
    """The licence in our spelling by its short name, or null for one that is not known to be free."""
    name = F.lower(text.trim(c))
    return F.coalesce(_looked_up(name, FREE_LICENCES), _looked_up(name, OPEN_LICENCES))


def licence_of_url(c: Column | str) -> Column:
    """The licence a Creative Commons address stands for: its code and version, for versions 3 and 4; else null."""
    url = F.lower(_col(c))
    code, version = F.regexp_extract(url, r"licenses/(by(?:-nc)?(?:-nd|-sa)?)/([34])", 1), F.regexp_extract(url, r"licenses/(by(?:-nc)?(?:-nd|-sa)?)/([34])", 2)
    return F.when(url.rlike("publicdomain/(zero|mark)"), "public domain").when(code != "", F.concat(F.lit("CC-"), F.upper(code), F.lit("-"), version, F.lit(".0")))


def hosts_in_prose(c: Column | str, most: int = 6) -> Column:
    """Names after "hosted by" and the like: capitalised, or a single word; at most so many."""
    told = F.regexp_extract(_col(c), java(HOSTED), 1)
    names = F.transform(F.split(told, java(r"(?i),|\band\b|&")), lambda n: F.regexp_replace(n, r"^[\s\-–—]+|[\s.,;]+$", ""))
    kept = F.filter(names, lambda n: F.length(n).between(2, 39) & n.rlike(r"^\p{L}[\p{L}.'-]*(?:\s+\p{L}[\p{L}.'-]*){0,3}$") & (n.rlike(r"^\p{Lu}") | ~F.contains(n, F.lit(" "))) & ~n.rlike(r"(?i)^(the|a|an|our|us|we|they|his|her|their)$"))
    return F.slice(kept, 1, most)


def read_character(c: Column | str) -> Column:
    """struct(role, character) of a catalogue's character text: who runs the game has no character, and a label is none."""
    value = text.trim(c)
    own = text.real_character(F.regexp_replace(value, r"(?i)^self\s*[,/-]\s*", ""))
    runs = F.coalesce(value.rlike(java(RUNS_THE_GAME)), F.lit(False))
    return F.struct(F.when(runs, "GM/DM").otherwise("player").alias("role"), F.when(~runs, own).alias("character"))


def bare_title(c: Column | str, purpose: str) -> Column:
    """A title for comparison: lower case, & as and, letters and digits only, without the words that are generic for the purpose."""
    words = F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "&", " and "), "[^a-z0-9]+", " ")
    generic = GENERIC_WORDS[purpose]
    return F.trim(F.regexp_replace(F.regexp_replace(words, generic, " ") if generic else words, " +", " "))


def season_title(c: Column | str) -> Column:
    """A season's title for comparison, its numbers as digits."""
    digits = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.array_join(F.transform(F.split(bare_title(c, "season"), " "), lambda w: F.coalesce(digits[w], w)), " ")


def series_of_episode(c: Column | str) -> Column:
    """The series in an episode's title: what comes before "- Episode" and the like, without a number at its end."""
    before = F.split(_col(c), r"(?i)\s*[-–—:]\s*(?:episode|ep\.?|part|session)(?![A-Za-z0-9_])", 2)[0]
    return text.trim(F.regexp_replace(before, r"\s*[-–—:]\s*\d+\s*$", ""))


def family_sort_name(name: Column | str, family: Column | str) -> Column:
    """"Family, rest" where the name ends with a known family name of any number of words, else by its last word."""
    full, last = text.trim(name), text.trim(family)
    given = text.trim(F.substr(full, F.lit(1), F.length(full) - F.length(last)))
    return F.when((last != "") & F.endswith(full, F.concat(F.lit(" "), last)), F.concat(last, F.lit(", "), given)).otherwise(text.sort_name(name))


def first_pattern(c: Column | str, table: list[tuple[str, str]]) -> Column:
    """The label of the first pattern of an ordered table that a text has."""
    return reduce(lambda case, row: case.when(_col(c).rlike(java(row[0])), row[1]), table[1:], F.when(_col(c).rlike(java(table[0][0])), table[0][1]))
