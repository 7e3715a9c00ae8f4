"""Passages of evaluation items inside a corpus.

A passage is a window of consecutive words. An error budget of k edits splits each window into k + 1 pieces, one of which stays
whole in any copy with at most k edits. All pieces of all items form one automaton that finds their exact hits in a document in one
pass over its characters. Hits on the same diagonal form runs; the windows around a run are verified with Myers' bit-parallel
distance, and the run's exact words are then counted.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph.llm.bpe import blocks

MIN_WORDS = 12
MAX_EDITS = 1
#: Items, and bytes of their texts, searched for in one pass over the corpus; more are searched for in further passes, which bounds what is
#: sent to tasks. Only an item that is longer by itself makes a greater pass.
ITEMS_A_PASS, BYTES_A_PASS = 20_000, 32 << 20

_separators = re.compile(r"[\W_]+")


#: For ASCII bytes: letters in lower case, digits, and a space for all else.
_ASCII = bytes(ord(chr(i).lower()) if i < 128 and chr(i).isalnum() else 32 for i in range(256))


def normal_words(text: str) -> str:
    """The words of the text in lower case, each after one space, and a space at the end."""
    if text.isascii():
        return f" {b' '.join(text.encode().translate(_ASCII).split()).decode()} "
    return f" {_separators.sub(' ', text.lower()).strip()} "


def myers(a: str, b: str, most: int) -> int:
    """Edits between two texts by Myers' bit vectors; most + 1 if there are more. What both begin and end with is left out."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = len(os.path.commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(os.path.commonprefix((a[::-1], b[::-1])))
    pattern, text = (a[: len(a) - end], b[: len(b) - end])
    m = len(pattern)
    if not m or not text:
        return min(max(m, len(text)), most + 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for left, c in zip(range(len(text) - 1, -1, -1), text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score - left > most:
            return most + 1
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
    return min(score, most + 1)


class Items:
    """The evaluation items as words, and the automaton of their pieces."""

    def __init__(self, items: list[tuple], min_words: int, max_edits: int):
        self.min_words, self.max_edits = min_words, max_edits
        self.piece_words = max(1, min_words // (max_edits + 1))
        self.items = [(key, normal_words(text).split()) for key, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (_, words) in enumerate(self.items):
            if len(words) >= min_words:
                for i in range(len(words) - self.piece_words + 1):
                    places.setdefault(f" {' '.join(words[i : i + self.piece_words])} ", []).append((n, i))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple]:
        """(item key, longest exact run in words, edits of the best window) of each item with a window in the text."""
        normal = normal_words(text)
        hits = [(end - size + 1, at) for end, (size, at) in self.automaton.iter(normal)]
        if not hits:
            return []
        words = normal.split()
        number, last = 0, 0  # the number of the word that begins at a hit
        diagonals: dict[tuple[int, int], list[int]] = {}
        for start, at in sorted(hits, key=lambda h: h[0]):
            number += normal.count(" ", last, start)
            last = start
            for n, i in at:
                diagonals.setdefault((n, number - i), []).append(i)
        best: dict[int, tuple[int, int]] = {}
        for (n, shift), found in diagonals.items():
            for first, end in self._runs(found):
                result = self._verify(n, shift, first, end, words)
                if result:
                    run, edits = best.get(n, (0, self.max_edits + 1))
                    best[n] = max(run, result[0]), min(edits, result[1])
        return [(self.items[n][0], run, edits) for n, (run, edits) in best.items()]

    def _runs(self, found: list[int]) -> Iterator[tuple[int, int]]:
        """First word and end of each run of neighbouring pieces on one diagonal."""
        found = sorted(set(found))
        first = last = found[0]
        for i in [*found[1:], None]:
            if i is None or i > last + 1:
                yield first, last + self.piece_words
                first = i
            last = i

    def _verify(self, n: int, shift: int, first: int, end: int, words: list[str]) -> tuple[int, int] | None:
        """(exact run, least edits) of the windows around a run of exact pieces, None if no window has few enough edits.

        An edit damages two words at most, so a window's other words must be in the document within max_edits places of the
        diagonal; only windows that have so many are measured.
        """
        item, w, k = self.items[n][1], self.min_words, self.max_edits
        a, b = first, end  # the exact check: the run of equal words around the hits
        while a > 0 and a - 1 + shift >= 0 and item[a - 1] == words[a - 1 + shift]:
            a -= 1
        while b < len(item) and b + shift < len(words) and item[b] == words[b + shift]:
            b += 1
        # Windows that hold a piece of the run at one of the pigeonhole's places; of a long run one inside it.
        starts = {a} if b - a >= w else {s for i in (first, end - self.piece_words) for j in range(k + 1) for s in (i - j * self.piece_words,)} | {a, b - w, a - 1, b - w + 1}
        areas = [(lo, hi) for lo in range(-k, k + 1) for hi in range(-k, k + 1) if abs(lo) + abs(hi) <= k]
        least = k + 1
        for s in starts:
            if s < 0 or s + w > len(item):
                continue
            whole = 0
            for i in range(s, s + w):
                whole += item[i] in words[max(0, i + shift - k) : max(0, i + shift + k + 1)]
            if whole >= w - 2 * k:
                window = " ".join(item[s : s + w])
                for lo, hi in areas:  # an edit of a space moves one end by a word
                    if 0 <= s + shift + lo:
                        least = min(least, myers(window, " ".join(words[s + shift + lo : s + shift + w + hi]), k))
                if not least:
                    break
        return None if least > k else (b - a, least)


def _passes(items: DataFrame, item_key: str, item_text: str) -> int:
    """The number of passes by which no pass has more than ITEMS_A_PASS items or BYTES_A_PASS bytes, unless it has one item only."""
    passes = 1
    while True:
        part = F.pmod(F.xxhash64(item_key), F.lit(passes))
        sizes = items.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(item_text)).alias("size"))
        beyond = sizes.where((F.col("n") > 1) & ((F.col("n") > ITEMS_A_PASS) | (F.col("size") > BYTES_A_PASS)))
        if beyond.isEmpty():
            return passes
        passes *= 2


def find_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS) -> DataFrame:
    """(key, item_key, n_words, edits): the items of which a window of min_words words is in a document with at most max_edits edits.

    n_words is the longest run of words the document shares exactly with the item, edits the least distance in characters of any
    window; with max_edits = 0 or the condition n_words >= min_words the leaks are exact. Words are maximal runs of letters or
    digits, compared without case. Null and empty texts, and items of fewer words than a window, give no row. Each document is
    searched whole, however long; the same text in several documents counts for each. A document and item give one row. Repeated
    document rows give repeated rows. Items are counted and measured first and searched for in passes, so what a task is sent
    has a bound whatever their number and length.
    """
    spark = documents.sparkSession
    kinds = documents.schema[key].dataType, items.schema[item_key].dataType
    schema = f"`{key}` {kinds[0].simpleString()}, `{item_key}` {kinds[1].simpleString()}, n_words int, edits int"
    wanted = items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(item_key, item_text).distinct()
    passes = _passes(wanted, item_key, item_text)
    source = documents.where(F.octet_length(text) >= 2 * min_words - 1).select(F.col(key), F.col(text))
    found = None
    for n in range(passes):
        part = wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64(item_key), F.lit(passes)) == n)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        some = source.mapInArrow(_searcher(shared, key, item_key, kinds, min_words, max_edits), schema)
        found = some if found is None else found.unionByName(some)
    return found


def _searcher(shared, key: str, item_key: str, kinds: tuple, min_words: int, max_edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, min_words, max_edits)
        for batch in batches:
            rows, owner = [], []
            if not items.empty:
                for a, texts in blocks(batch.column(1)):
                    for i, text in enumerate(texts, a):
                        for row in items.search(text):
                            owner.append(i)
                            rows.append(row)
            if rows:
                item, words, edits = zip(*rows)
                columns = [batch.column(0).take(pa.array(owner)), pa.array(item), pa.array(words, pa.int32()), pa.array(edits, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[key, item_key, "n_words", "edits"])

    return run
