"""Freely typed values mapped to the closest entry of a reference list.

All spellings of the entries (names, joined words, publisher and name, initials, aliases) are paths of one trie. A value is searched
in it word by word with a Levenshtein automaton whose budget depends on the word's length; a branch is left as soon as its
automaton can no longer accept. All entries within distance come back, of which the nearest name, and its right edition, is taken.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castgraph.llm.textnorm import normaliser

UNMATCHED = "unmatched"
#: Entries of one trie and bytes of their text; a longer list is searched in several passes, which bounds what the driver and tasks hold at once.
ENTRIES_A_PASS, BYTES_A_PASS = 50_000, 32 << 20
#: Values a worker remembers; only speed depends on it.
REMEMBERED = 200_000

# Other usual labels of the credit fields.
FIELD_ALIASES = {
    "game_master": ["gm", "dm", "game master", "gamemaster", "game mistress", "dungeon master", "dungeon mistress", "keeper", "referee", "storyteller", "narrator", "run by", "mastered by"],
    "guest_game_master": ["guest gm", "guest dm", "guest game master", "guest gamemaster", "guest dungeon master", "guest keeper", "visiting gm", "visiting dm", "visiting game master", "gamemaster guest", "game master guest", "gm guest", "dm guest"],
    "players": ["player", "players", "cast", "main cast", "regular cast", "starring", "stars", "playing", "played by", "party", "party members", "cast members"],
    "guest_players": ["guest", "guests", "guest player", "guest players", "guest star", "guest stars", "guest starring", "guest cast", "special guest", "special guests", "player guest", "players guest"],
    "host": ["host", "hosts", "hosted by", "presenter", "presenters", "presented by", "moderator", "moderators", "moderated by"],
    "producer": ["producer", "producers", "produced by", "production", "prod", "executive producer", "executive producers"],
    "editor": ["editor", "editors", "edited by", "editing", "video editor", "audio editor", "video editing", "audio editing"],
    "composer": ["composer", "composers", "composed by", "music", "music by", "theme music", "theme music by", "original music", "original score", "score", "score by"],
    "writer": ["writer", "writers", "written by", "writing", "story by", "adventure writer", "adventure by", "author"],
    "director": ["director", "directors", "directed by", "direction", "dir"],
    "sound_designer": ["sound designer", "sound designers", "sound design", "sound designed by", "sound design by", "soundscape", "soundscapes", "sound"],
    "illustrator": ["illustrator", "illustrators", "illustrated by", "illustration", "illustrations", "art", "art by", "artist", "artwork", "artwork by", "character art", "character artist"],
}
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth"]
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]
# End of fixed values.

_edition = re.compile(
    r"\(?\b(?:(\d{1,2})\s*(?:st|nd|rd|th)?\s*(?:edition|ed|e)\b\.?|(?:edition|ed)\b\.?\s*(\d{1,2}|[ivx]+)\b|v\.?\s*(\d{1,2})\b|(" + "|".join(ORDINALS) + r")\s+(?:edition|ed)\b\.?)\)?", re.I
)
_noise = re.compile(r"\((?:homebrew[^)]*|modified|beta|house rules)\)|-\s*house rules\b|\b(?:ttrpg|rpg|role-?playing game)\b", re.I)
_link = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_tag = re.compile(r"<ref[^>]*>.*?</ref>|<[^>]*>|\{\{|\}\}", re.S | re.I)
_number = re.compile(r"(?:\s+|^)\d{1,3}$")


def budget(length: int) -> int:
    """Edits allowed in a word of the length; a swap of neighbours is one."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Levenshtein automaton (with swaps) of a word: a state is the band of a row of the distance table that can stay within the budget.

    At depth i the band has the cells i - most to i + most of the row; all others exceed the budget. So a step costs the budget, not the word's length.
    """

    def __init__(self, word: str, most: int):
        self.word, self.most, self.size = word, most, 2 * most + 1

    def start(self) -> tuple:
        return 0, tuple(j if j >= 0 else self.most + 1 for j in range(-self.most, self.most + 1)), None, ""

    def step(self, state: tuple, c: str) -> tuple | None:
        depth, row, above, last = state
        word, beyond, j, new = self.word, self.most + 1, depth - self.most, []
        for b in range(self.size):  # the cell of the word's first j + 1 letters
            cost = beyond
            if j == -1:
                cost = depth + 1
            elif 0 <= j < len(word):
                cost = row[b] + (word[j] != c)
                if b and new[-1] < cost:
                    cost = new[-1] + 1
                if b + 1 < self.size and row[b + 1] < cost:
                    cost = row[b + 1] + 1
                if above is not None and j and word[j] == last and word[j - 1] == c and above[b] < cost:
                    cost = above[b] + 1
            new.append(min(cost, beyond))
            j += 1
        if min(new) > self.most and min(row) > self.most:
            return None
        return depth + 1, tuple(new), row, c

    def distance(self, state: tuple) -> int:
        b = len(self.word) - state[0] + self.most
        return state[1][b] if 0 <= b < self.size else self.most + 1


class Trie:
    """Spelled paths, words parted by spaces, with the numbers of their entries."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, path: str, entry: int) -> None:
        node = self.root
        for c in path:
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(entry)

    def search(self, words: list[str], exact: bool = False) -> dict[int, int]:
        """Least distance of each entry of which some path has as many words, each within its word's budget; with `exact`, within none."""
        allowed = (lambda length: 0) if exact else budget
        found: dict[int, int] = {}
        level = [(self.root, 0)]
        for i, word in enumerate(words):
            automaton, after = Automaton(word, allowed(len(word) + 1)), []
            for node, passed in level:
                stack = [(node, automaton.start(), 0)]
                while stack:
                    at, state, depth = stack.pop()
                    d = automaton.distance(state)
                    if depth and d <= allowed(max(len(word), depth)):
                        if i == len(words) - 1:
                            for entry in at.get("", ()):
                                found[entry] = min(found.get(entry, 99), passed + d)
                        elif " " in at:
                            after.append((at[" "], passed + d))
                    for c, child in at.items():
                        if len(c) == 1 and c != " ":
                            then = automaton.step(state, c)
                            if then is not None:
                                stack.append((child, then, depth + 1))
            level = after
        return found


@dataclass(frozen=True)
class Entry:
    """An entry: its id, the key of the name it shares with other editions, its edition, and all its spellings."""

    id: str
    name: str
    edition: int | None
    paths: tuple[str, ...]


def plain(text: str) -> str:
    """Lower case without accents, one consistent form of its characters."""
    text = normaliser().canonical(text).casefold()
    if text.isascii():
        return text
    text = unicodedata.normalize("NFD", text)
    return "".join(c for c in text if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    """Words of letters and digits; & is "and", a possessive ending is dropped."""
    text = re.sub(r"['’`]s\b|['’`]", "", plain(text)).replace("&", " and ")
    return re.findall(r"[a-z0-9]+", text) if text.isascii() else re.findall(r"[^\W_]+", text)


def _initials(text: str) -> str:
    return "".join(w[0] for w in re.findall(r"[^\W_]+", plain(text)))


def _edition_number(match: re.Match) -> int | None:
    value = next((g for g in match.groups() if g), "").lower()
    if value.isdigit():
        return int(value)
    if value in ORDINALS:
        return ORDINALS.index(value) + 1
    return ROMAN.index(value) + 1 if value in ROMAN else None


def read_edition(text: str) -> tuple[str, int | None]:
    """The text without its edition, and the edition's number."""
    for match in _edition.finditer(text):
        number = _edition_number(match)
        if number is not None:
            return text[: match.start()] + " " + text[match.end() :], number
    return text, None


def game_entry(game_id: str, name: str, edition: str | None, publisher: str | None) -> Entry:
    words, maker = words_of(name), words_of(publisher or "")
    bare = words[1:] if words[:1] == ["the"] and len(words) > 1 else words
    paths = {" ".join(w) for w in (words, bare, ["the", *bare], ["".join(words)], ["".join(bare)])}
    short = _initials(name)
    if maker:
        paths |= {" ".join([*maker, *w]) for w in (words, bare, ["".join(bare)])}
        paths |= {" ".join([*w, *maker]) for w in (words, bare)}
        if len(short) > 1:
            paths.add(" ".join([short, *maker]))
    return Entry(game_id, " ".join(bare), read_edition(edition or "")[1], tuple(sorted(paths)))


def field_entry(field_id: str, label: str | None, aliases: list[str] | None = None) -> Entry:
    spellings = {" ".join(words_of(s)) for s in [field_id, label or field_id, *(aliases or [])]}
    spellings |= {s.replace(" ", "") for s in spellings if len(s) > 6}
    return Entry(field_id, field_id, None, tuple(sorted(spellings)))


def clean(text: str) -> str:
    """Without wiki links, tags, entities and outer blanks; of a link its label counts."""
    return _tag.sub(" ", _link.sub(r"\1", html.unescape(text))).strip()


class Mapper:
    """Maps values of one kind, "game" or "field", to entries."""

    def __init__(self, kind: str, entries: list[Entry]):
        self.kind, self.entries = kind, entries
        self.trie = Trie()
        for n, e in enumerate(entries):
            for path in e.paths:
                self.trie.add(path, n)

    def _spellings(self, text: str) -> list[list[str]]:
        words = words_of(text)
        out = [words, ["".join(words)]]
        letters = re.match(r"\s*((?:[A-Za-z]\s*&\s*)+[A-Za-z])\b(.*)", text, re.S)
        if letters:  # initials with & between them
            out.append([re.sub(r"[\s&]", "", letters.group(1)).lower(), *words_of(letters.group(2))])
        return [w for n, w in enumerate(out) if w and w not in out[:n]]

    def candidates(self, value: str, nearest: bool = False) -> list[tuple[str, str, int | None, int]]:
        """(id, name, edition, distance) of all entries within distance of the value; with `nearest`, those at no distance if there are any.

        The automaton is first run without a budget, which follows one path only, and then with each word's.
        """
        text = clean(value)
        if self.kind == "game":
            text = _noise.sub(" ", read_edition(_noise.sub(" ", text))[0])
        else:
            text = _number.sub("", re.sub(r"\(s\)|[:*#]+", " ", re.sub(r"[_\s]+", " ", text), flags=re.I).strip())
        best: dict[int, int] = {}
        for exact in (True, False) if nearest else (False,):
            for words in self._spellings(text):
                for n, d in self.trie.search(words, exact).items():
                    best[n] = min(best.get(n, 99), d)
            if best:
                break
        return [(self.entries[n].id, self.entries[n].name, self.entries[n].edition, d) for n, d in sorted(best.items())]


def resolve(kind: str, value: str, candidates: list) -> str:
    """The entry meant: of the nearest name the edition the value states, or its only one; `unmatched` if the list has none."""
    if not candidates:
        return UNMATCHED
    least = min(c[3] for c in candidates)
    name = min(c[1] for c in candidates if c[3] == least)
    same = [c for c in candidates if c[1] == name]
    if kind != "game":
        return min(c[0] for c in same)
    stated = read_edition(_noise.sub(" ", clean(value)))[1]
    fits = sorted({c[0] for c in same if stated is None or c[2] == stated})
    return fits[0] if len(fits) == 1 or (fits and stated is not None) else UNMATCHED


def _passes(entries: DataFrame) -> list[DataFrame]:
    """The list in parts of at most ENTRIES_A_PASS entries and BYTES_A_PASS bytes, but for an entry that is longer by itself."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in entries.columns), F.lit(0))
    passes = 1
    while True:
        part = F.pmod(F.xxhash64("id"), F.lit(passes))
        beyond = entries.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).where((F.col("n") > 1) & ((F.col("n") > ENTRIES_A_PASS) | (F.col("size") > BYTES_A_PASS)))
        if beyond.isEmpty():
            return [entries.where(part == n) for n in range(passes)] if passes > 1 else [entries]
        passes *= 2


def game_list(games: DataFrame) -> DataFrame:
    return games.where("id IS NOT NULL AND name IS NOT NULL").select("id", "name", "edition", "publisher").distinct()


def field_list(fields: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(id, label, spellings): the entries with the spellings a table (id, alias) has for them."""
    rows = fields.where("id IS NOT NULL").groupBy("id").agg(F.min("label").alias("label"))
    if aliases is None:
        return rows.withColumn("spellings", F.array().cast("array<string>"))
    return rows.join(aliases.where("alias IS NOT NULL").groupBy("id").agg(F.collect_set("alias").alias("spellings")), "id", "left")


def field_aliases(spark: SparkSession) -> DataFrame:
    """(id, alias): the usual labels above as a table; any other table of the kind can be passed instead."""
    return spark.createDataFrame([(i, a) for i, aliases in FIELD_ALIASES.items() for a in aliases], "id string, alias string")


def _mapper(kind: str, rows: list[tuple]) -> Mapper:
    return Mapper(kind, sorted((game_entry(*r) if kind == "game" else field_entry(*r) for r in rows), key=lambda e: (e.name, e.id)))


_workers: dict[tuple, tuple] = {}


def _worker(kind: str, rows, use: str) -> tuple[Mapper, dict]:
    """This worker's mapper of a broadcast list and the values it has mapped for a use; both outlive the task."""
    key = kind, use, id(rows.value)
    if key not in _workers:
        if len(_workers) > 8:
            _workers.clear()
        _workers[key] = _mapper(kind, rows.value), {}, rows.value
    return _workers[key][:2]


CANDIDATES = "array<struct<id: string, name: string, edition: int, distance: int>>"


def candidates(values: Column, kind: str, rows, nearest: bool = False) -> Column:
    """All entries of one pass (a broadcast of its rows) within distance of each value."""

    @F.pandas_udf(CANDIDATES)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mapper, known = _worker(kind, rows, "nearest" if nearest else "all")
        for part in parts:
            yield _each(part, known, lambda v: [dict(zip(("id", "name", "edition", "distance"), c)) for c in mapper.candidates(v, nearest)], [])

    return run(values)


def _each(part: pd.Series, known: dict, function, otherwise) -> pd.Series:
    """The function of each value, worked out once a value; `otherwise` for null and blank ones."""
    if len(known) > REMEMBERED:
        known.clear()
    for value in part.dropna().unique():
        if value not in known:
            known[value] = function(value) if value.strip() else otherwise
    return pd.Series([otherwise if v is None or v != v else known[v] for v in part], index=part.index)


def mapped(df: DataFrame, column: str, kind: str, entries: DataFrame) -> DataFrame:
    """`df` with ref_id, the id of the entry each value of the column means, or `unmatched`; null and blank values are unmatched.

    Rows are mapped where they are, without a shuffle; a worker searches a value once however often it comes, so a value that
    fills a third of the rows costs no more than another. Of a list of several passes each is broadcast by itself, and the entries
    found in all of them are weighed together.
    """
    shared = [df.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()]) for part in _passes(entries)]
    if len(shared) == 1:

        @F.pandas_udf("string")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            mapper, known = _worker(kind, shared[0], "meant")
            for part in parts:
                yield _each(part, known, lambda v: resolve(kind, v, mapper.candidates(v, nearest=True)), UNMATCHED)

        return df.withColumn("ref_id", run(column))

    @F.pandas_udf("string")
    def weigh(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, found in parts:
            yield pd.Series([resolve(kind, v, [(c["id"], c["name"], None if c["edition"] is None or c["edition"] != c["edition"] else int(c["edition"]), c["distance"]) for c in some]) if v is not None and v.strip() else UNMATCHED for v, some in zip(values, found)])

    for n, rows in enumerate(shared):
        df = df.withColumn(f"_pass{n}", candidates(F.col(column), kind, rows, nearest=True))
    return df.withColumn("ref_id", weigh(column, F.concat(*[f"_pass{n}" for n in range(len(shared))]))).drop(*[f"_pass{n}" for n in range(len(shared))])


def _systems(campaigns: DataFrame) -> DataFrame:
    return campaigns.where(F.length(F.trim(F.regexp_replace("system", r"[\s\p{Z}]+", " "))) > 0).select("campaign_id", F.lit(-1).alias("group_pos"), F.col("system").alias("value"))


def _fields(campaigns: DataFrame) -> DataFrame:
    groups = campaigns.select("campaign_id", F.posexplode("credits").alias("group_pos", "_g")).where(F.col("_g").isNotNull())
    return groups.select("campaign_id", "group_pos", F.col("_g.field").alias("value"))


def map_campaigns(campaigns: DataFrame, games: DataFrame, fields: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(campaign_id, group_pos, value, ref_id): each system that is not blank (group_pos -1) and each credit group's field.

    A value with no entry has ref_id `unmatched`. Null and blank systems, null arrays and null groups give no row; a group with a
    null or blank field is unmatched. Empty lists make everything unmatched. Repeated campaign rows give repeated rows. `aliases` has
    further spellings (id, alias) of the fields.
    """
    systems = mapped(_systems(campaigns), "value", "game", game_list(games))
    return systems.unionByName(mapped(_fields(campaigns), "value", "field", field_list(fields, aliases)))


def entries_within(campaigns: DataFrame, games: DataFrame, fields: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(value, is_system, id, distance): all entries within distance of each distinct value, by the automaton; values without any give no row."""
    spark, out = campaigns.sparkSession, None
    for kind, values, entries in (("game", _systems(campaigns), game_list(games)), ("field", _fields(campaigns), field_list(fields, aliases))):
        distinct = values.where(F.col("value").isNotNull()).select("value").distinct()
        for part in _passes(entries):
            rows = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
            found = distinct.select("value", F.lit(kind == "game").alias("is_system"), F.explode(candidates(F.col("value"), kind, rows)).alias("_c")).select("value", "is_system", "_c.id", "_c.distance")
            out = found if out is None else out.unionByName(found)
    return out


def unmatched_report(rows: DataFrame) -> DataFrame:
    """Values without an entry with the number of rows that have them."""
    return rows.where(F.col("ref_id") == UNMATCHED).groupBy((F.col("group_pos") == -1).alias("is_system"), "value").agg(F.count(F.lit(1)).alias("n_rows"))
