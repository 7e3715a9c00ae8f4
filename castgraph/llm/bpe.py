"""Byte-level byte-pair encoding of a whole corpus with a public vocabulary.

Texts are split into words by the vocabulary's pattern. The distinct words of a batch that are not known yet are laid out as one
sequence of symbols, and every pair of neighbours that has a rank is entered into an index from rank to all its positions.
Ranks are applied in ascending order; applying one joins the pair at each of its positions and enters the pairs that arise, which
always have a higher rank, so one pass over the ranks encodes all words. Texts then only gather the ids of their words.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castgraph.llm.textnorm import ranges

#: Folder of the public vocabularies, unless a path is given.
TOKENIZERS = os.environ.get("CASTGRAPH_TOKENIZERS", "/opt/tokenizers")
#: Code points of text taken at once, which bounds the words held by a worker.
BLOCK_CHARS = 8 << 20
#: Distinct words whose ids a worker remembers; it starts anew beyond. Only speed depends on it.
KNOWN_WORDS = 400_000

# The pattern of the vocabulary, with white space as Unicode defines it.
_SPACE = "\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
# End of fixed values.

_exact = regex.compile(PATTERN)
#: The same split by the faster module, right for text without the characters of odd_class.
_fast = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_controls = re.compile("[\x1c-\x1f]")


def odd_class() -> str:
    """The characters that the two modules put into different classes, as the inside of a character class."""
    odd = []
    for p in range(0x80, sys.maxunicode + 1):
        c = chr(p)
        kind = unicodedata.category(c)[0]
        fast = "N" if c.isdecimal() else "L" if c.isalnum() else "S" if c.isspace() else "O"
        if fast != (kind if kind in "LN" else "S" if c in _SPACE else "O"):
            odd.append(p)
    return ranges(odd)


class Splitter:
    """Splits text into the words of the pattern, by the faster module wherever that is the same."""

    def __init__(self, odd: str):
        self.odd = re.compile(f"[{odd}]")

    def words(self, text: str) -> list[str]:
        """The words of the text, which joined give the text again."""
        plain = _controls.search(text) is None and (text.isascii() or self.odd.search(text) is None)
        return (_fast if plain else _exact).findall(text)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids of single bytes and, by rank, the pairs that are joined and the id they become."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = [vocab[x] for x in byte_letters()]
        self.left, self.right, self.joined = [], [], []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.left.append(vocab[a])
            self.right.append(vocab[b])
            self.joined.append(vocab[a + b])
        self.odd = odd_class()

    def ranks(self) -> dict[int, int]:
        return {a << 32 | b: r for r, (a, b) in reversed(list(enumerate(zip(self.left, self.right))))}


class Encoder:
    """Encodes lists of words; keeps what it has encoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.rank = vocabulary.ranks()
        self.split = Splitter(vocabulary.odd).words
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.flat, self.offsets = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's begin, by the pair occurrence index."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        ids = np.array(self.v.byte_ids, dtype=np.int64)
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        symbols = ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        total = len(symbols) + len(raw)
        ends = np.cumsum(sizes + 1) - 1
        laid = np.full(total, -1, dtype=np.int64)  # -1 stands between words and joins with nothing
        gap = np.ones(total, dtype=bool)
        gap[ends] = False
        laid[gap] = symbols
        token = laid.tolist()
        after, before = list(range(1, total + 1)), list(range(-1, total - 1))
        if total:
            after[-1] = total - 1  # the last place is a separator
        rank = self.rank
        occurs: list[list[int] | None] = [None] * len(self.v.left)
        pairs = (laid[:-1] << 32 | laid[1:]).tolist() if total else []
        for at, pair in enumerate(pairs):
            r = rank.get(pair)
            if r is not None:
                if occurs[r] is None:
                    occurs[r] = [at]
                else:
                    occurs[r].append(at)
        get = rank.get
        for r in range(len(occurs)):
            places = occurs[r]
            if places is None:
                continue
            a, b, c = self.v.left[r], self.v.right[r], self.v.joined[r]
            if a == b:
                places.sort()  # of overlapping pairs the leftmost is joined first
            for at in places:
                if token[at] != a:
                    continue
                then = after[at]
                if token[then] != b or then == at:
                    continue
                token[at], token[then] = c, -2
                beyond = after[then]
                after[at] = beyond
                before[beyond] = at
                follows = token[beyond]
                if follows >= 0:
                    q = get(c << 32 | follows)
                    if q is not None:
                        if occurs[q] is None:
                            occurs[q] = [at]
                        else:
                            occurs[q].append(at)
                ahead = before[at]
                if ahead >= 0 and token[ahead] >= 0:
                    q = get(token[ahead] << 32 | c)
                    if q is not None:
                        if occurs[q] is None:
                            occurs[q] = [ahead]
                        else:
                            occurs[q].append(ahead)
            occurs[r] = None
        done = np.array(token, dtype=np.int64)
        left = done >= 0
        counts = np.add.reduceat(left.astype(np.int64), np.concatenate([[0], ends[:-1] + 1])) if len(raw) else np.zeros(0, dtype=np.int64)
        return done[left].astype(np.int32), counts

    def add(self, words: list[str]) -> None:
        """Make the distinct words known."""
        if len(self.known) + len(words) > KNOWN_WORDS:
            self._forget()
        new = [w for w in words if w not in self.known]
        if new:
            flat, counts = self._encode_new(new)
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new))))
            self.flat = np.concatenate([self.flat, flat])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, by which flat and offsets give its ids; all become known."""
        if not words:
            return np.zeros(0, dtype=np.int64)
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.add(distinct)
        at = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return at[coded.indices.to_numpy(zero_copy_only=False)]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered words in a row, and how many each has."""
        start = self.offsets[numbers]
        size = self.offsets[numbers + 1] - start
        shift = np.repeat(start - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(len(shift))], size

    def encode(self, text: str) -> list[int]:
        return self.gather(self.numbers(self.split(text)))[0].tolist()

    def count(self, text: str) -> int:
        return len(self.encode(text))


def vocabulary_path(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, f"{name}.json")


_encoders: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """This worker's encoder of a broadcast vocabulary; it outlives the batch, so known words stay known."""
    vocabulary = shared.value
    if id(vocabulary) not in _encoders:
        _encoders.clear()
        _encoders[id(vocabulary)] = Encoder(vocabulary)
    return _encoders[id(vocabulary)]


def share_vocabulary(spark: SparkSession, path: str | None = None):
    """The vocabulary as a broadcast; its size is that of the vocabulary file, whatever the corpus."""
    return spark.sparkContext.broadcast(Vocabulary(path or vocabulary_path()))


def blocks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """A batch's texts in runs of about BLOCK_CHARS bytes, each with the row it begins at; a longer text is a run by itself.

    Only one run at a time becomes Python strings, whatever the batch holds.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > BLOCK_CHARS:
            yield begin, column.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(sizes):
        yield begin, column.slice(begin).to_pylist()


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens; strings that look like one are ordinary text.

    Null and empty texts give an empty list. Texts of any length are encoded whole. Repeated rows give repeated rows, an empty
    table an empty one, and other columns are ignored.
    """
    shared = share_vocabulary(df.sparkSession, path)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for a, texts in blocks(batch.column(1)):
                words = [encoder.split(t) if t else [] for t in texts]
                each = np.fromiter(map(len, words), dtype=np.int64, count=len(texts))
                ids, size = encoder.gather(encoder.numbers([w for ws in words for w in ws]))
                passed = np.concatenate([[0], np.cumsum(size)])
                offsets = passed[np.concatenate([[0], np.cumsum(each)])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), lists], names=[key, "ids"])

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)
