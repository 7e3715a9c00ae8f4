"""Variant spellings of people's names, attributed to the person they most probably mean.

A name is read into tokens (reordered, joined, abbreviated or handle forms included). The noisy channel gives the likelihood that one
spelling came out of another by a typing error, an abbreviation, a nickname, another order. Spellings used within one show are
ranked, frequent full forms first, as candidate canonical forms; each lower one is attached to the candidate of greatest posterior
(likelihood times frequency), unless an unrelated person of that name being in the show is more probable.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph.llm import textnorm, titles
from castgraph.llm.reflist import plain
from castgraph.llm.titles import swaps_distance
from castgraph.session import cut, release

# Usual short forms of given names, titles before names, letters without a decomposition, Cyrillic letters as Latin ones.
SHORT_FORMS = {
    "alexander": "alex al sandy sasha xander", "alexandra": "alex sandra sasha lexi", "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benji benny", "catherine": "cathy kate cat",
    "charles": "charlie chuck chas", "christina": "chris tina", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie", "edward": "ed eddie ted ned",
    "elizabeth": "liz beth betty eliza lizzie libby", "francesca": "fran frankie", "francis": "frank fran", "frederick": "fred freddie freddy", "gabriella": "gabi gabby", "gregory": "greg", "isabella": "bella izzy",
    "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "jack johnny", "jonathan": "jon jonny nathan", "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh",
    "katherine": "kate kathy katie kat kit", "kenneth": "ken kenny", "laurence": "larry", "leonardo": "leo", "margaret": "maggie meg peggy", "matthew": "matt matty", "michael": "mike mick mikey", "nathaniel": "nate nat",
    "nicholas": "nick nicky", "pamela": "pam", "patricia": "pat trish tricia patty", "patrick": "pat paddy", "peter": "pete", "philip": "phil", "rebecca": "becky becca", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie bert",
    "ronald": "ron", "samantha": "sam", "samuel": "sam sammy", "stephanie": "steph", "steven": "steve", "susan": "sue", "theodore": "ted theo teddy", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim timmy",
    "valentina": "val tina", "victoria": "vicky tori vic", "vincent": "vince", "william": "bill will billy liam", "zachary": "zach",
}
HONORIFICS = {"dr", "prof", "professor", "mr", "mrs", "ms", "mx", "sir", "dame", "rev", "lord", "lady"}
SUFFIXES = {"jr", "sr", "phd", "md", "esq"}
NO_DECOMPOSITION = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"})
CYRILLIC = str.maketrans(dict(zip("абвгдезийклмнопрстуфхцыэ", "abvgdezijklmnoprstufhcye")) | {"ж": "zh", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya", "ь": "", "ъ": "", "ё": "e"})
# End of fixed values.

_FORMAL: dict[str, set[str]] = {}
for _long, _shorts in SHORT_FORMS.items():
    for _short in _shorts.split():
        _FORMAL.setdefault(_short, set()).add(_long)

# Natural logarithms of the probabilities that a name comes out of another in these ways.
SAME, ORDER, INITIAL, ABBREVIATED, NICKNAME, JOINED, HANDLE, MIDDLE, RESPELT, SCRIPT = 0.0, -1.0, -2.5, -3.0, -2.5, -3.0, -3.0, -2.5, -4.5, -4.0
#: One edit: a fifteenth of names have one, at one of some 30 usual places and letters.
TYPO = math.log(1 / 15) - math.log(30)
#: Probability that a spelling of a show is another form of some name of it; that a name in a wiki is one of its show's.
ANOTHER_FORM, NAMED_IN_SHOW = 0.1, 0.7
#: Namesakes of a mention that may be expected by chance where no show confirms it.
NAMESAKES = 0.2


@dataclass(frozen=True)
class Name:
    """A name read: tokens in their order, each with its kind: "w" a word, "i" an initial, "a" an abbreviation; a handle's letters."""

    tokens: tuple[tuple[str, str], ...]
    handle: str
    foreign: bool

    @property
    def joined(self) -> str:
        return "".join(t for t, _ in self.tokens)

    @property
    def fullness(self) -> int:
        return sum(len(t) for t, k in self.tokens if k == "w") if not self.handle and not self.foreign else 0


_quoted = re.compile(r"[\"“”«»„][^\"“”«»„]*[\"“”«»„]|\s'[^']+'(?=\s)")
_bracketed = re.compile(r"\([^)]*\)|\[[^\]]*\]")
_camel = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_handle = re.compile(r"@?([^\W\d_]+)[._]?([^\W\d_]*)[._]?\d{1,4}")
_marks = re.compile(r"[\"“”«»„'()\[\]_*]")


@lru_cache(maxsize=30_000)
def read_name(text: str) -> Name:
    if not text.isascii() or not text.isprintable():  # printable ASCII is its own consistent form
        text = textnorm.normaliser().canonical(text)
    text = text.strip()
    if text[-1:].isdecimal() and (whole := _handle.fullmatch(text.replace(" ", ""))):
        return Name(((fold(whole.group(1) + whole.group(2)), "w"),), fold(whole.group(1) + whole.group(2)), False)
    if _marks.search(text):
        text = _bracketed.sub(" ", _quoted.sub(" ", f" {text} ")).replace("_", " ").replace("*", " ")
    if " " not in text.strip():
        text = _camel.sub(" ", text.strip())
    last, comma, first = text.partition(",")
    if comma and first.strip() and fold(first.strip().strip(".")) not in SUFFIXES:
        text = f"{first} {last}"
    tokens: list[tuple[str, str]] = []
    for raw in text.split():
        word = fold(raw if raw.isalnum() else re.sub(r"[\W_]+", "", raw))
        if not word or (word in HONORIFICS and not tokens) or (word in SUFFIXES and tokens):
            continue
        kind = "i" if len(word) == 1 else "a" if raw.endswith(".") and len(word) <= 4 else "w"
        tokens.append((word, kind))
    letters = "".join(t for t, _ in tokens)
    foreign = not letters.isascii() and any("Ѐ" <= c <= "ӿ" for c in letters)
    return Name(tuple(tokens), "", foreign)


def fold(text: str) -> str:
    if text.isascii() and text.isprintable():
        return text.lower()
    return plain(text).translate(NO_DECOMPOSITION)


@lru_cache(maxsize=30_000)
def respelt(word: str) -> str:
    """A form in which words that sound alike are spelt alike."""
    for a, b in (("ie", "i"), ("ph", "f"), ("ck", "k"), ("x", "ks"), ("qu", "kv"), ("q", "k"), ("c", "k"), ("w", "v"), ("y", "i"), ("z", "s"), ("th", "t")):
        word = word.replace(a, b)
    return re.sub(r"(.)\1", r"\1", word)


def transliterated(name: Name) -> str:
    """A form shared by a name in Cyrillic letters and the same name in Latin ones."""
    return transliterate(name.joined)


def transliterate(text: str) -> str:
    text = text.translate(CYRILLIC)
    for a, b in (("w", "u"), ("x", "h"), ("q", "k"), ("y", "i")):
        text = text.replace(a, b)
    return text


def _token(a: tuple[str, str], b: tuple[str, str]) -> float | None:
    (x, i), (y, j) = a, b
    if x == y:
        return SAME
    if "i" in (i, j):
        return INITIAL if x[0] == y[0] or _nick_initial(a, b) else None
    if "a" in (i, j):
        short, long = (x, y) if i == "a" else (y, x)
        return ABBREVIATED if long.startswith(short) else None
    if x in _FORMAL.get(y, ()) or y in _FORMAL.get(x, ()) or (x in _FORMAL and y in _FORMAL and _FORMAL[x] & _FORMAL[y]):
        return NICKNAME
    length = min(len(x), len(y))
    if length >= 3:
        d = swaps_distance(x, y, 2)
        if d == 1:
            return TYPO if length >= 4 else TYPO - 1.5
        if respelt(x) == respelt(y):
            return RESPELT
        if d == 2 and length >= 8:
            return 2 * TYPO
        if (x in _FORMAL or y in _FORMAL) and d <= 2:
            return None
    return None


def _nick_initial(a: tuple[str, str], b: tuple[str, str]) -> bool:
    (short, _), (word, kind) = (a, b) if a[1] == "i" else (b, a)
    return kind == "w" and any(f[0] == short for f in _FORMAL.get(word, ()))


@lru_cache(maxsize=20_000)
def channel(a: str, b: str) -> float | None:
    """Log likelihood that one of two spellings is a form of the other; None if it isn't."""
    x, y = read_name(a), read_name(b)
    if not x.tokens or not y.tokens:
        return None
    if x.handle or y.handle:
        return _by_handle(x, y)
    if x.foreign != y.foreign:
        s, t = transliterated(x), transliterated(y)
        return SCRIPT if s == t or (len(s) > 7 and swaps_distance(s, t, 1) <= 1) else None
    best = None

    def take(value: float) -> None:
        nonlocal best
        best = value if best is None or value > best else best

    if x.tokens == y.tokens:
        return SAME
    for one, two in ((x, y), (y, x)):
        if len(one.tokens) <= len(two.tokens) <= len(one.tokens) + 2:
            for skipped in _subsets(two.tokens, len(two.tokens) - len(one.tokens)):
                lost = MIDDLE * (len(two.tokens) - len(one.tokens))
                for turn in range(len(one.tokens)):
                    turned = one.tokens[turn:] + one.tokens[:turn]
                    costs, words = [], False
                    for p, q in zip(turned, skipped):
                        cost = _token(p, q)
                        if cost is None:
                            break
                        costs.append(cost)
                        words = words or cost > INITIAL - 4 and p[1] == q[1] == "w" and len(p[0]) >= 3
                    else:
                        if words:
                            take(sum(costs) + lost + (ORDER if turn else 0))
    if len(x.joined) > 5 and len(x.tokens) != len(y.tokens):
        for turn in range(len(y.tokens)):
            d = swaps_distance(x.joined, "".join(t for t, _ in y.tokens[turn:] + y.tokens[:turn]), 1)
            if d <= 1:
                take(JOINED + d * TYPO + (ORDER if turn else 0))
    return best


def _subsets(tokens: tuple, leave: int) -> list[tuple]:
    """The tokens without `leave` inner ones, initials or words of an unused middle name."""
    if not leave:
        return [tokens]
    if len(tokens) < 3:
        return []
    if leave == 1:
        return [tokens[:i] + tokens[i + 1 :] for i in range(1, len(tokens) - 1)]
    return [(tokens[0], tokens[-1])] if len(tokens) == leave + 2 else []


def _by_handle(x: Name, y: Name) -> float | None:
    if x.handle and y.handle:
        return SAME if x.handle == y.handle else None
    handle, other = (x.handle, y) if x.handle else (y.handle, x)
    if other.foreign:
        return None
    for turn in range(len(other.tokens)):
        words = [t for t, _ in other.tokens[turn:] + other.tokens[:turn]]
        if len(words) >= 2 and handle.startswith(words[0]) and len(handle) - len(words[0]) >= 3 and words[-1].startswith(handle[len(words[0]) :]):
            return HANDLE + (ORDER if turn else 0)
    return None


def handle_prefixes(handle: str) -> list[str]:
    """Beginnings of a handle of which one is a first name with three letters of a last name, however the handle is put together."""
    return [handle[:n] for n in range(4, len(handle) + 1)]


def edge_keys(word: str) -> list[tuple[str, bool]]:
    """Keys of which two words that fit each other share one: less any letter, as they sound, their formal names; initials have none."""
    if word.endswith("."):
        return []
    keys = {word, *(word[:i] + word[i + 1 :] for i in range(len(word))), "~" + respelt(word)} if len(word) > 2 else set()
    return [(k, True) for k in {*keys, "=" + word, *("=" + f for f in _FORMAL.get(word, ()))}]


def word_fits(a: str, b: str) -> bool:
    """Whether a word may be a form of another by itself: mistyped, respelt, a nickname."""
    return _token((a, "w"), (b, "w")) is not None


def _halves(word: str) -> list[str]:
    """Beginnings and ends of about half of a word, of which two words one edit or swap apart share one."""
    return [half for n in {len(word) // 2, (len(word) - 1) // 2} if n for half in (f"{word[:n]}-", f"-{word[-n:]}")]


def name_keys(text: str, near: dict[str, list[str]] | None = None) -> list[tuple[str, bool]]:
    """Keys of which any two spellings that the channel can join share one, each with whether the spelling looks for others by it.

    The channel needs two words of each name to fit each other. `near` has the words that a rarer word of the name fits, so keys name words as they are: (w)
    two words, each also as those it fits, (i) one word and the initial of another, for which abbreviated names look; (x) halves of
    all letters, for which joined, longer and foreign names look; (h) a first name with three letters of a last one, for which handles look. All words of
    a name are read.
    """
    name, near = read_name(text), near or {}
    if not name.tokens:
        return []
    if name.handle:
        return [("h:" + p, True) for p in handle_prefixes(name.handle)] + [("h=" + name.handle, True)]
    keys: dict[str, bool] = {}

    def key(k: str, seeks: bool = True) -> None:
        keys[k] = keys.get(k, False) or seeks

    tokens, words = name.tokens, [t for t, _ in name.tokens]
    for turn in [words[i:] + words[:i] for i in range(len(words))]:
        for end in _halves(transliterate("".join(turn))):
            key(f"x:{end}", name.foreign or len(words) != 2)
        if len(words) > 1 and not name.foreign:
            key("h:" + turn[0] + turn[-1][:3], False)
    if len(words) == 1:
        for w in (words[0], *near.get(words[0], ())):
            key(f"w:{w}")
    for n, (word, kind) in enumerate(tokens):
        if kind != "w":
            continue
        forms = (word, *near.get(word, ()))
        for m, (other, other_kind) in enumerate(tokens):
            if m == n:
                continue
            short = other_kind != "w"
            if len(word) >= 3:
                for c in {other[0], *(f[0] for f in _FORMAL.get(other, ()))}:
                    for a in forms:
                        key(f"i:{a}|{c}", short)
            if not short and m > n and max(len(word), len(other)) >= 3:
                for a in forms:
                    for b in (other, *near.get(other, ())):
                        key(f"w:{min(a, b)}|{max(a, b)}")
    return sorted(keys.items())


def whole_key(text: str) -> str | None:
    """A key that spellings of the same full words share in any order and script form; handles have their own; None for abbreviated names."""
    name = read_name(text)
    if name.handle:
        return "h:" + text.casefold().strip()
    if len(name.tokens) < 2 or any(k != "w" for _, k in name.tokens):
        return None
    return "n:" + " ".join(sorted(t for t, _ in name.tokens))


def mistyped(a: str, b: str) -> bool:
    """Whether two spellings have the same number of whole words, in some turn equal but for typing errors in at least one."""
    x, y = read_name(a), read_name(b)
    if x.handle or y.handle or x.foreign or y.foreign or len(x.tokens) != len(y.tokens) or {k for _, k in x.tokens + y.tokens} != {"w"}:
        return False
    for turn in range(len(x.tokens)):
        costs = [_token(p, q) for p, q in zip(x.tokens[turn:] + x.tokens[:turn], y.tokens)]
        if all(c == SAME or c is not None and c <= TYPO for c in costs) and min(costs) < SAME:
            return True
    return False


def tokens_of(text: str) -> list[str]:
    return [t if k == "w" else t[0] + "." for t, k in read_name(text).tokens]


def _per_name(column: str, kind: str, function) -> Column:
    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(function)

    return run(column)


def likelihood(a: str, b: str) -> Column:
    """struct(log_l, typo): the channel's log likelihood of two spellings, null if none, and whether only typing errors part them."""

    @F.pandas_udf("log_l double, typo boolean")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in parts:
            found = [channel(s, t) for s, t in zip(x, y)]
            yield pd.DataFrame({"log_l": pd.Series(found, dtype="float64"), "typo": [c is not None and c <= TYPO + 1 and mistyped(s, t) for c, s, t in zip(found, x, y)]})

    return run(a, b)


def consistent(df: DataFrame, column: str) -> DataFrame:
    """The column in its consistent form, lower case kept for camel forms only; null or blank values drop out."""
    plain_ascii = F.col(column).rlike(r"\A[ -~]*\z")
    both = df.where(plain_ascii).unionByName(df.where(~plain_ascii).withColumn(column, textnorm.canonical(column)))
    shown = both.withColumn(column, F.trim(F.regexp_replace(column, r"\s+", " ")))
    return shown.where(F.col(column) != "")


def person_spellings(people: DataFrame) -> DataFrame:
    """(id, name): each person's canonical names and alias names in consistent form."""
    all_names = F.concat(F.array("canonical_name"), F.coalesce(F.transform("aliases", lambda a: a["name"]), F.array().cast("array<string>")))
    spelt = people.where(F.col("id").isNotNull()).select("id", F.explode(all_names).alias("name"))
    return consistent(spelt.where(F.col("name").isNotNull()).distinct(), "name").distinct()


def person_shows(people: DataFrame) -> DataFrame:
    """(id, show) of each person's credits."""
    shows = people.where(F.col("id").isNotNull()).select("id", F.explode(F.transform("credits", lambda c: c["show"])).alias("show"))
    return shows.where(F.col("show").isNotNull()).distinct()


def known_shows(cast: DataFrame, shows: DataFrame) -> DataFrame:
    """`cast` with, for references to no show, also the one show whose title the reference spells up to typing errors."""
    ids = shows.where(F.col("id").isNotNull()).select(F.col("id").alias("show")).distinct()
    unknown = cast.select("show").distinct().join(ids, "show", "left_anti")
    # A reference is the words of a title, with or without one further part that tells equal titles apart.
    forms = F.array(F.col("show"), F.regexp_replace("show", r"-[^-]*$", ""))
    spelt = unknown.select(F.col("show").alias("l"), F.explode(F.transform(forms, lambda f: F.replace(f, F.lit("-"), F.lit(" ")))).alias("title"))
    found = titles.pairs(spelt, shows.where(F.col("id").isNotNull()).select(F.col("id").alias("r"), "title")).where(F.col("score") >= 0.85)
    best = found.groupBy("l").agg(F.max(F.struct("score", "r")).alias("best")).select(F.col("l").alias("show"), F.col("best.r").alias("meant"))
    return cast.unionByName(cast.join(best, "show").select("id", F.col("meant").alias("show"))).distinct()


def campaign_shows(campaigns: DataFrame, shows: DataFrame) -> DataFrame:
    """(campaign_id, show): the shows a wiki page may be about, by title or page name: those of its best similarity."""
    pages = campaigns.select("campaign_id", F.explode(F.array("title", "page")).alias("title"))
    found = titles.pairs(pages.withColumnRenamed("campaign_id", "l"), shows.where(F.col("id").isNotNull()).select(F.col("id").alias("r"), "title"))
    best = found.groupBy("l").agg(F.max("score").alias("best"))
    near = found.join(best, "l").where((F.col("score") >= 0.5) & (F.col("score") >= F.col("best") - 0.04))
    return near.select(F.col("l").alias("campaign_id"), F.col("r").alias("show"))


def mentions(campaigns: DataFrame) -> DataFrame:
    """(key, campaign_id, name) of each person named in a wiki credit group; null people and names drop out."""
    groups = campaigns.select("campaign_id", F.posexplode("credits").alias("g", "_g"))
    named = groups.select("campaign_id", "g", F.posexplode("_g.people").alias("p", "_p")).select("campaign_id", "g", "p", F.col("_p.name").alias("name"))
    keyed = named.where(F.col("name").isNotNull()).select(F.concat_ws(":", F.lit("wiki"), "campaign_id", "g", "p").alias("key"), "campaign_id", "name")
    return consistent(keyed, "name")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id each id is linked with, over edges (a, b).

    Labels fall to the least of the neighbours' and then jump to their label's label, so chains shorten by half each round;
    every round is written to the shared checkpoint folder. Rounds go on until no label changes, which they do as labels only fall. Only links between different ids take part.
    """
    links = edges.where(F.col("a") != F.col("b"))
    links = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        labels = state.select("id", "root")
        near = links.join(labels.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        jump = lower.select(F.col("id").alias("root"), F.col("root").alias("then"))
        after = cut(lower.join(jump, "root", "left").select("id", F.least("root", F.coalesce("then", "root")).alias("root"), "old"))
        release(state)
        state = after
        if state.where(F.col("root") != F.col("old")).isEmpty():
            release(links)
            return state.select("id", "root")


READ = "tokens array<string>, fullness int"


def reading(column: str) -> Column:
    """A spelling's tokens and fullness."""

    def read(text: str) -> tuple:
        name = read_name(text)
        return tokens_of(text), name.fullness

    @F.pandas_udf(READ)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([read(t) for t in part], columns=["tokens", "fullness"])

    return run(column)


def _rarity(spellings: DataFrame) -> DataFrame:
    """(name, log_p, fullness, given): log probability of a spelling by the frequencies of its tokens among all spellings; the name and, for each of
    its words that fits more frequent ones, the word with those."""
    names = cut(spellings.select("name").distinct().withColumn("_r", reading("name")).select("name", "_r.*"))
    tokens = names.select("name", F.explode("tokens").alias("word"))
    counts = cut(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    edges = titles.edges(counts, edge_keys, word_fits)
    total = names.agg((F.count(F.lit(1)) + 1.0).alias("total"))
    rare = tokens.join(counts, "word").join(edges, "word", "left").crossJoin(F.broadcast(total))  # one row
    rare = rare.groupBy("name").agg(F.sum(F.log(F.col("n") / F.col("total"))).alias("log_p"), F.collect_set(F.concat_ws(" ", "word", "near")).alias("near"))
    known = names.join(rare, "name", "left").select("name", F.greatest(F.coalesce("log_p", F.lit(0.0)), F.lit(-40.0)).alias("log_p"), "fullness", F.concat(F.array("name"), F.coalesce("near", F.array().cast("array<string>"))).alias("given"))
    known = cut(known)
    release(names, counts, edges)
    return known


@dataclass(frozen=True)
class Spellings:
    """What the attribution reads, each written once: spellings and casts of people, mentions and their shows, rarity of names."""

    spelt: DataFrame
    cast: DataFrame
    wiki: DataFrame
    pages: DataFrame
    rarity: DataFrame


def prepare(people: DataFrame, campaigns: DataFrame, shows: DataFrame) -> Spellings:
    spelt, wiki = cut(person_spellings(people)), cut(mentions(campaigns))
    shown, credited = cut(shows.where(F.col("id").isNotNull()).select("id", "title").distinct()), cut(person_shows(people))
    cast, pages = cut(known_shows(credited, shown)), cut(campaign_shows(campaigns, shown))
    release(shown, credited)
    return Spellings(spelt, cast, wiki, pages, _rarity(spelt.select("name").unionByName(wiki.select("name"))))


def _by_all_shows(turned: DataFrame, of_people: DataFrame, cast: DataFrame) -> DataFrame:
    """Links (a, b) of ids by all shows both are credited in: a namesake would have to be in each of them by chance.

    Of N people, N p have the lower name p by chance and each is in a show of c people with probability c / N. With one show this is
    the test within that show.
    """
    ids = of_people.select(F.xxhash64("show", "name").alias("node"), "id")
    met = turned.join(ids.select(F.col("node").alias("low_node"), F.col("id").alias("a")), "low_node").join(ids.select(F.col("node").alias("high_node"), F.col("id").alias("b")), "high_node").where(F.col("a") != F.col("b"))
    people = cast.agg(F.count_distinct("id").alias("n_people"))
    met = met.crossJoin(F.broadcast(people))  # one row
    in_show = F.log(F.least(F.col("cast_size"), F.col("n_people")) / F.col("n_people"))
    met = met.groupBy("a", "b", "low_name", "high_name").agg(
        F.max("log_l").alias("log_l"), F.max("low_log_p").alias("low_log_p"), F.max("n_people").alias("n_people"), F.sum(in_show).alias("in_shows"), F.count(F.lit(1)).alias("n_shows"), F.sum(F.col("high_n_ids") + F.col("high_n_keys")).alias("n")
    )
    odds = F.col("log_l") + math.log(ANOTHER_FORM) - (F.log("n_people") + F.col("low_log_p") + F.col("in_shows"))
    likely = met.where((F.col("n_shows") > 1) & (odds > 0))
    best = likely.groupBy("a", "low_name").agg(F.max(F.struct(F.col("log_l") + F.log("n"), F.col("n_shows"), "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def attribute(given: Spellings, with_mentions: bool = True) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Links (a, b) between ids of one person, (key, id) of wiki mentions and ids they mean, and the written tables both read.

    Everything is keyed by show: spellings that occur in a show are its nodes, however many records use them, and only nodes of one
    show that share a name key are compared. A hot show or name thus gives no group of all its pairs.

    Without mentions only the links are found, and they are the same: a spelling no person has links nobody, so it is compared with none.
    """
    cast = given.cast
    of_people = cut(given.spelt.join(cast, "id").select("show", "name", "id"))
    of_wiki = cut(given.wiki.join(given.pages, "campaign_id").select("show", "name", "key"))

    nodes = of_people.groupBy("show", "name").agg(F.count(F.lit(1)).alias("n_ids"), F.min("id").alias("least"), F.lit(0).alias("n_keys")).unionByName(
        of_wiki.groupBy("show", "name").agg(F.lit(0).cast("long").alias("n_ids"), F.lit(None).cast("string").alias("least"), F.count(F.lit(1)).cast("int").alias("n_keys"))
    )
    nodes = nodes.groupBy("show", "name").agg(F.sum("n_ids").alias("n_ids"), F.min("least").alias("least"), F.sum("n_keys").alias("n_keys"))
    sizes = cast.groupBy("show").agg(F.count(F.lit(1)).alias("cast_size"))
    nodes = nodes.join(sizes, "show", "left").join(given.rarity.drop("given"), "name")
    nodes = cut(nodes.withColumn("node", F.xxhash64("show", "name")))

    keyed = titles.with_keys(given.rarity.select("name", "given"), "given", lambda g: name_keys(g[0], {w: rest for w, *rest in map(str.split, g[1:]) if rest}))
    compared = nodes if with_mentions else nodes.where("n_ids > 0")
    keyed = compared.select("show", "name", "node", (F.col("n_ids") > 0).alias("known")).join(keyed, "name")
    keyed = cut(keyed.select("node", "known", F.xxhash64("show", "key").alias("k"), F.col("flag").alias("seeks")))
    seekers, others = keyed.where("seeks").select("k", F.col("node").alias("a"), F.col("known").alias("a_known")), keyed.select("k", F.col("node").alias("b"), F.col("known").alias("b_known"))
    met = seekers.join(others, "k").where((F.col("a") != F.col("b")) & (F.col("a_known") | F.col("b_known")))
    ahead = ~F.col("a_known") | (F.col("b_known") & (F.col("a") < F.col("b")))  # a mention, else the lesser node, comes first
    pairs = cut(met.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("v"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("c")).distinct())
    release(keyed)

    def side(prefix: str) -> DataFrame:
        return nodes.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("node", "name", "n_ids", "n_keys", "least", "log_p", "fullness", "cast_size")])

    judged = pairs.join(side("v"), F.col("v") == F.col("v_node")).join(side("c"), F.col("c") == F.col("c_node"))
    judged = judged.withColumn("_l", likelihood("v_name", "c_name")).select("*", "_l.*").where(F.col("log_l").isNotNull())
    judged = cut(judged.select("v", "c", "log_l", "typo", *[f"{p}_{c}" for p in "vc" for c in ("n_ids", "n_keys", "least", "log_p", "fullness")], F.col("c_cast_size").alias("cast_size"), F.col("c_name"), F.col("v_name")))

    # Between people: the lower ranked form attaches to the higher one of greatest posterior. Of two spellings that a typing error
    # parts, the one of rarer words is the lower, whatever their counts: it is the one that a namesake hardly has.
    rarer = lambda p: F.when(F.col("typo"), F.col(f"{p}_log_p")).otherwise(0.0)
    rank = lambda p: F.struct(F.col(f"{p}_fullness") > 0, rarer(p), F.col(f"{p}_n_ids") + F.col(f"{p}_n_keys"), F.col(f"{p}_fullness"), F.col(f"{p}_name"))
    columns = ["node", "name", "least", "n_ids", "n_keys", "log_p"]
    turned = judged.where("v_n_ids > 0").withColumn("up", rank("v") < rank("c"))
    pick = lambda c, low: F.when(F.col("up"), F.col(f"v_{c}" if low else f"c_{c}")).otherwise(F.col(f"c_{c}" if low else f"v_{c}")).alias(f"{'low' if low else 'high'}_{c}")
    turned = turned.withColumns({"v_node": F.col("v"), "c_node": F.col("c")}).select("log_l", "cast_size", *[pick(c, low) for c in columns for low in (True, False)])
    turned = cut(turned)
    odds = F.col("log_l") + math.log(ANOTHER_FORM) - (F.log(F.greatest(F.col("cast_size"), F.lit(1))) + F.col("low_log_p"))
    posterior = F.struct(F.col("log_l") + F.log(F.col("high_n_ids") + F.col("high_n_keys")), F.col("high_least"))
    chosen = turned.where(odds > 0).groupBy("low_node").agg(F.max(F.struct(posterior, F.col("high_least").alias("b"), F.col("low_least").alias("a"))).alias("best"))
    by_name = chosen.select("best.a", "best.b").unionByName(_by_all_shows(turned, of_people, cast))

    # The same spelling is a form of itself: it passes the same test.
    chance = F.log(F.greatest(F.coalesce("cast_size", F.lit(1)), F.lit(1))) + F.col("log_p")
    shared = nodes.where((F.col("n_ids") > 1) & (F.lit(SAME + math.log(ANOTHER_FORM)) - chance > 0))
    same_node = of_people.join(shared.select("show", "name", "least"), ["show", "name"]).select(F.col("id").alias("a"), F.col("least").alias("b"))
    links = by_name.unionByName(same_node).where(F.col("a") != F.col("b")).distinct()

    written = [of_people, of_wiki, nodes, pairs, judged, turned]
    if not with_mentions:
        return links, None, written

    # Mentions: the same spelling in the show, else the person's form of greatest posterior.
    direct = nodes.where((F.col("n_ids") > 0) & (F.col("n_keys") > 0) & (F.lit(SAME + math.log(NAMED_IN_SHOW)) - chance > 0)).select("node", "least")
    named = judged.where("v_n_ids = 0").where(F.col("log_l") + math.log(NAMED_IN_SHOW) - F.log(F.greatest(F.col("cast_size"), F.lit(1))) - F.when(F.col("typo"), F.least("v_log_p", "c_log_p")).otherwise(F.col("v_log_p")) > 0)
    named = named.groupBy(F.col("v").alias("node")).agg(F.max(F.struct(F.col("log_l") + F.log("c_n_ids"), F.col("c_least").alias("least"))).alias("best")).select("node", "best.least")
    meant = of_wiki.withColumn("node", F.xxhash64("show", "name")).join(direct.unionByName(named), "node").select("key", F.col("least").alias("id")).distinct()
    return links, meant, written


def same_people(people: DataFrame, campaigns: DataFrame, shows: DataFrame) -> DataFrame:
    """(id, root) of ids that are not alone."""
    given = prepare(people, campaigns, shows)
    links, _, read = attribute(given, with_mentions=False)
    groups = components(links)
    release(*read, *vars(given).values())
    return groups


def by_whole_name(given: Spellings, rest: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, id) of mentions that no show could attribute, if just one person has all words of the name and a namesake is improbable."""
    key = _per_name("name", "string", whole_key)
    spelt = given.spelt
    keyed = spelt.withColumn("whole", key).where("whole IS NOT NULL").join(groups, "id", "left").select("whole", "id", F.coalesce("root", "id").alias("root"))
    sole = keyed.groupBy("whole").agg(F.min("root").alias("root"), F.max("root").alias("other"), F.min("id").alias("id")).where(F.col("root") == F.col("other"))
    people_count = spelt.agg(F.count_distinct("id").alias("n_people"))
    named = rest.withColumn("whole", key).where("whole IS NOT NULL").join(sole.select("whole", "id"), "whole").join(given.rarity, "name")
    likely = named.crossJoin(F.broadcast(people_count)).where(F.log("n_people") + F.col("log_p") < math.log(NAMESAKES))  # one row
    return likely.select("key", "id")


def person_links(people: DataFrame, campaigns: DataFrame, shows: DataFrame) -> DataFrame:
    """(left_key, right_key): each pair of ids that are one person, and each wiki mention with every id of its person.

    Null or blank names, null ids, null arrays and null elements take no part; repeated rows change nothing; people and
    mentions that no show connects stay apart. Empty tables give no pair. Names of any length are read whole.
    """
    given = prepare(people, campaigns, shows)
    links, meant, read = attribute(given)
    groups, by_shows = components(links), cut(meant)
    meant = cut(by_shows.unionByName(by_whole_name(given, given.wiki.join(by_shows.select("key").distinct(), "key", "left_anti"), groups)))
    release(by_shows, *read, *vars(given).values())
    other = groups.select(F.col("id").alias("b"), "root")
    of_ids = groups.select(F.col("id").alias("a"), "root").join(other, "root").where(F.col("a") < F.col("b"))
    roots = meant.join(groups, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    members = roots.select("key", "root").distinct().join(groups.select("root", F.col("id").alias("member")), "root").select("key", F.col("member").alias("id"))
    of_wiki = roots.select("key", "id").unionByName(members).distinct()
    key = lambda c: F.concat(F.lit("person:"), F.col(c))
    return of_ids.select(key("a").alias("left_key"), key("b").alias("right_key")).unionByName(of_wiki.select(key("id").alias("left_key"), F.col("key").alias("right_key")))
