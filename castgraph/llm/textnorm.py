"""One consistent form for text that looks the same.

A quick check finds the segments of a text that normalisation may change: runs of characters whose NFKC quick-check property is
not "yes", each with the starter before it and the combining marks after it as context. Only those segments are normalised; the
canonical segments are spliced into the unchanged rest. Invisible characters are dropped, every other space becomes U+0020, and in
a word that mixes Latin letters with look-alikes of another script the look-alikes become Latin. Words wholly in another script
stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look like Latin ones, from Cyrillic and Greek.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "ï", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ё": "ë", "г": "r", "п": "n", "ь": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ї": "Ï", "Ј": "J", "Ѕ": "S", "Һ": "H", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I", "Ё": "Ë", "З": "3", "Ѵ": "V",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ϲ": "c", "Ϲ": "C", "ϳ": "j",
}
#: Characters that show nothing though their category is not Cf: joiners, fillers and variation selectors.
INVISIBLE_OTHERS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
# End of fixed values.


def ranges(points: list[int]) -> str:
    """The code points as the inside of a character class."""
    out, first, last = [], None, None
    for p in [*points, None]:
        if p is not None and last is not None and p == last + 1:
            last = p
            continue
        if first is not None:
            out.append(re.escape(chr(first)) + ("-" + re.escape(chr(last)) if last > first else ""))
        first = last = p
    return "".join(out)


#: Planes that can hold assigned characters; the others are unassigned or for private use, which no class has.
PLANES = [range(0x80, 0x40000), range(0xE0000, 0xF0000)]


@lru_cache(maxsize=1)
def classes() -> dict[str, str]:
    """Character classes by the rules of the Unicode database: unstable, mark, invisible, space."""
    unstable, marks, invisible, spaces = [], [], [], []
    composing = set()
    for p in chain(*PLANES):  # the second characters of canonical compositions are "maybe"
        d = unicodedata.decomposition(chr(p))
        if d and d[0] != "<" and " " in d:
            composing.add(int(d.split()[1], 16))
    for p in chain(*PLANES):
        if 0xD800 <= p < 0xE000:
            continue
        c = chr(p)
        category = unicodedata.category(c)
        if category == "Cn" or category == "Co":
            continue
        if unicodedata.combining(c):
            marks.append(p)
        if category == "Cf" or c in INVISIBLE_OTHERS or 0xE0100 <= p <= 0xE01EF:
            invisible.append(p)
        elif category in ("Zs", "Zl", "Zp") or p == 0x85:
            spaces.append(p)
        elif p in composing or 0x1160 < p < 0x1200 or not unicodedata.is_normalized("NFKC", c):
            unstable.append(p)
    return {"unstable": ranges(sorted({*unstable, *marks})), "mark": ranges(marks), "invisible": ranges(invisible), "space": ranges(spaces)}


class Normaliser:
    """Compiled quick checks. `canonical` gives the consistent form, `is_case` tells whether a name is built from other characters."""

    def __init__(self) -> None:
        c = classes()
        # The starter before an unstable run and the marks after it are its boundary context.
        self.segment = re.compile(f"[^{c['mark']}]?[{c['unstable']}]+[{c['mark']}]*")
        self.invisible = re.compile(f"[{c['invisible']}]+")
        self.space = re.compile(f"[\\t-\\r\\x1c-\\x1f{c['space']}]")
        self.word = re.compile(r"[^\W\d_]+")
        self.foreign = re.compile("[" + "".join(LOOK_ALIKES) + "]")
        self.table = str.maketrans(LOOK_ALIKES)

    def _word(self, match: re.Match) -> str:
        word = match.group()
        if not self.foreign.search(word):
            return word
        latin = sum("LATIN" in unicodedata.name(ch, "") for ch in word)
        return word.translate(self.table) if latin else word

    def unmixed(self, text: str) -> str:
        """Look-alikes in words that also hold Latin letters made Latin."""
        return self.word.sub(self._word, text) if self.foreign.search(text) else text

    def normal(self, text: str) -> str:
        """NFKC of the unstable segments only, spliced into the rest."""
        return self.segment.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)

    def canonical(self, text: str) -> str:
        """The consistent form; ordinary spaces and words wholly in another script are kept."""
        if text.isascii():
            return self.space.sub(" ", text) if self.space.search(text) else text
        text = self.invisible.sub("", text)
        text = self.space.sub(" ", text)
        return self.unmixed(self.normal(text))

    def is_case(self, text: str) -> bool:
        """Whether the text differs from its consistent form."""
        return self.canonical(text) != text


@lru_cache(maxsize=1)
def normaliser() -> Normaliser:
    return Normaliser()


def canonical(column: Column | str) -> Column:
    """The consistent form of a string column. Null stays null, empty stays empty; texts of any length are normalised whole.

    Texts of plain ASCII never leave the JVM's batch unchanged by more than a scan: the quick check passes them as they are.
    """

    @F.pandas_udf("string")
    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = normaliser()
        for part in values:
            yield part.map(n.canonical, na_action="ignore")

    return run(column)


def _names(people: DataFrame) -> DataFrame:
    canonical_names = people.select("rec_no", F.lit(-1).alias("pos"), F.col("canonical_name").alias("name"))
    aliases = people.select("rec_no", F.posexplode(F.transform("aliases", lambda a: a["name"])).alias("pos", "name"))
    return canonical_names.unionByName(aliases).where(F.col("name").isNotNull())


def canonical_names(people: DataFrame) -> DataFrame:
    """(rec_no, pos, name, consistent, is_case) of every name that is not null; pos is -1 for canonical_name, else the alias's position.

    A JVM quick check keeps printable ASCII names away from Python: they are their own consistent form. Null aliases, null
    arrays and empty tables give no row; repeated people rows are distinct by rec_no; other columns are ignored.
    """
    names = _names(people)
    plain = F.col("name").rlike(r"\A[ -~]*\z")
    stable = names.where(plain).withColumn("consistent", F.col("name"))
    other = names.where(~plain).withColumn("consistent", canonical("name"))
    both = stable.unionByName(other)
    return both.withColumn("is_case", F.col("consistent") != F.col("name"))
