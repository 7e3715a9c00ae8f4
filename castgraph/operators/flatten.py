"""Nested records as flat linked tables, by structural indexing of their JSON text.

The text of a batch is one byte array. Bitmaps of quotes, brackets and delimiters are computed for all of it at once, nesting
depth is a prefix sum over the brackets outside strings, and the elements of an array are the spans between its brackets and
the commas one level deeper. Nothing is parsed record by record, and unwanted parts of a record are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of JSON text indexed at once; a longer record is still taken whole.
BLOCK_BYTES = 2 << 20


@dataclass(frozen=True)
class Child:
    """A flat child table: its name, the key of a record's array, and the key of an array inside that array's objects, if any."""

    name: str
    array: str
    inner: str | None = None


class StructuralIndex:
    """Bitmaps and depths of a block of JSON records."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends
        n = len(data)
        place = np.arange(n, dtype=np.int64)
        other = np.where(data != 92, place, -1)  # the last byte that is no backslash
        other = np.maximum.accumulate(other) if n else other
        quotes = np.flatnonzero(data == 34)
        before = np.where(quotes > 0, other[quotes - 1], -1)
        self.quotes = quotes[((quotes - 1 - before) & 1) == 0] if n else quotes  # after an even run of backslashes
        # The parity of quotes is counted within each record: one broken record does not affect the next.
        mark = np.zeros(n + 1, dtype=np.int32)
        mark[self.quotes + 1] = 1
        passed = np.cumsum(mark)
        lengths = ends - starts
        record_of = np.repeat(np.arange(len(starts)), lengths) if len(starts) else np.zeros(0, dtype=np.int64)
        base = passed[starts] if len(starts) else np.zeros(0, dtype=np.int64)
        outside = ((passed[:n] - base[record_of]) & 1) == 0 if n else np.zeros(0, dtype=bool)
        opens = outside & ((data == 91) | (data == 123))
        closes = outside & ((data == 93) | (data == 125))
        step = opens.astype(np.int32) - closes.astype(np.int32)
        total = np.concatenate([[0], np.cumsum(step)])
        depth_before = total[:n] - total[starts][record_of] if n else total[:0]
        # Depth of a bracket is that outside of it, of a delimiter that of the container it separates.
        self.open = np.flatnonzero(opens)
        self.close = np.flatnonzero(closes)
        self.open_depth = depth_before[self.open]
        self.close_depth = depth_before[self.close] - 1
        self.comma = np.flatnonzero(outside & (data == 44))
        self.comma_depth = depth_before[self.comma]
        self.colon = np.flatnonzero(outside & (data == 58))
        self.colon_depth = depth_before[self.colon]
        self.record_of = record_of
        self.text = np.flatnonzero((data != 32) & (data != 9) & (data != 10) & (data != 13))  # all bytes but blanks

    def _next(self, at: np.ndarray) -> np.ndarray:
        """The first byte from each place on that is no blank, however many blanks come first; the end of the block if there is none."""
        if not len(self.text):
            return np.full(len(at), len(self.data))
        n = np.searchsorted(self.text, at)
        return np.where(n < len(self.text), self.text[np.minimum(n, len(self.text) - 1)], len(self.data))

    def _before(self, end: np.ndarray) -> np.ndarray:
        """The place after the last byte before each end that is no blank; 0 if there is none."""
        if not len(self.text):
            return np.zeros(len(end), dtype=np.int64)
        n = np.searchsorted(self.text, end) - 1
        return np.where(n >= 0, self.text[np.maximum(n, 0)] + 1, 0)

    def arrays(self, key: str, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Brackets of the arrays that are the values of `key` in objects whose members have the depth."""
        colon = self.colon[self.colon_depth == depth]
        name = key.encode()
        at = np.searchsorted(self.quotes, colon)  # the quotes around the key are the last two before its colon
        ok = at >= 2
        colon, at = colon[ok], at[ok]
        last, first = self.quotes[at - 1], self.quotes[at - 2]
        fits = last - first == len(name) + 1
        colon, first = colon[fits], first[fits]
        if not len(colon):
            return colon, colon
        spelt = self.data[first[:, None] + 1 + np.arange(len(name))]
        colon = colon[(spelt == np.frombuffer(name, dtype=np.uint8)).all(axis=1)]
        at = np.searchsorted(self.open, colon)
        ok = at < len(self.open)
        colon, at = colon[ok], at[ok]
        opened = self.open[at]
        # The value is an array if its bracket is the first byte after the colon that is no blank.
        value = self._next(colon + 1)
        opened = opened[(opened == value) & (self.data[opened] == 91)]
        return opened, self._ends(opened, depth)

    def _ends(self, opened: np.ndarray, depth: int) -> np.ndarray:
        same = self.close[self.close_depth == depth]
        at = np.searchsorted(same, opened)
        found = np.where(at < len(same), same[np.minimum(at, max(len(same) - 1, 0))] if len(same) else 0, len(self.data))
        return np.minimum(found, self.ends[self.record_of[opened]])

    def elements(self, opened: np.ndarray, closed: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Array number, position, start and end of each element of arrays whose members have the depth."""
        comma = self.comma[self.comma_depth == depth]
        lo, hi = np.searchsorted(comma, opened), np.searchsorted(comma, closed)
        count = hi - lo + 1
        owner = np.repeat(np.arange(len(opened)), count)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        number = np.repeat(lo, count) + pos
        start = np.where(pos == 0, opened[owner], comma[np.minimum(np.maximum(number - 1, 0), max(len(comma) - 1, 0))] if len(comma) else opened[owner]) + 1
        last = pos == count[owner] - 1
        end = np.where(last, closed[owner], comma[np.minimum(number, max(len(comma) - 1, 0))] if len(comma) else closed[owner])
        start = np.minimum(self._next(start), end)
        end = np.maximum(self._before(end), start)
        size = end - start
        first = self.data[np.minimum(start, len(self.data) - 1)] if len(self.data) else start
        real = (size > 0) & ~((size == 4) & (first == 110))  # neither an empty array nor null
        return owner[real], pos[real], start[real], end[real]


def _index_block(keys: pa.Array, text: pa.Array, children: list[Child]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    index = StructuralIndex(data, offsets[:-1], offsets[1:])
    whole = data.tobytes()
    for child in children:
        opened, closed = index.arrays(child.array, 1)
        owner, pos, start, end = index.elements(opened, closed, 2)
        record = index.record_of[opened][owner] if len(opened) else owner
        if child.inner is None:
            sub = np.full(len(pos), -1)
        else:
            inner, inner_end = index.arrays(child.inner, 3)
            at = np.searchsorted(start, inner, side="right") - 1  # the element that holds the inner array
            held = (at >= 0) & (inner < end[np.maximum(at, 0)]) if len(start) else np.zeros(len(inner), dtype=bool)
            inner, inner_end, at = inner[held], inner_end[held], at[held]
            array, sub, start, end = index.elements(inner, inner_end, 4)
            record, pos = record[at[array]], pos[at[array]]
        yield child.name, record, pos, sub, [whole[a:b] for a, b in zip(start.tolist(), end.tolist())]


def flatten_json(df: DataFrame, key: str, text: str, children: list[Child]) -> DataFrame:
    """(key, child, pos, subpos, value): one row per element that is not null of each child array, value being its JSON text.

    pos is the element's position in the record's array; subpos is -1, or for an inner array's element its own position, pos
    then being that of the object that holds the array. A null or empty text, an absent, null or empty array and null elements
    give no row; null elements keep their positions. Text that is no JSON object of the expected shape gives no or
    only those rows that can be read, and never affects other records. Repeated records give repeated rows.
    """
    kind = df.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind), T.StructField("child", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("subpos", T.IntegerType()), T.StructField("value", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).cast(pa.string())
            sizes = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0)
            block = np.cumsum(sizes) // BLOCK_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                some = keys.slice(a, b - a)
                for name, record, pos, sub, values in _index_block(some, texts.slice(a, b - a), children):
                    if len(values):
                        yield pa.RecordBatch.from_arrays(
                            [
                                some.take(pa.array(record)),
                                pa.array(np.full(len(values), name, dtype=object), pa.string()),
                                pa.array(pos.astype(np.int32)),
                                pa.array(sub.astype(np.int32)),
                                pa.array(values, pa.binary()).cast(pa.string()),
                            ],
                            names=[key, "child", "pos", "subpos", "value"],
                        )

    return df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(key, text).mapInArrow(run, schema)


PEOPLE_CHILDREN = [Child("alias", "aliases"), Child("credit", "credits"), Child("source", "credits", "sources")]
SHOW_CHILDREN = [Child("season", "seasons")]


def _as_json(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("rec_no", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("_json"))


def nested_elements(people: DataFrame, shows: DataFrame) -> DataFrame:
    """All elements of people's aliases, credits and sources and of shows' seasons: (src, rec_no, child, pos, subpos, value)."""
    parts = [
        flatten_json(_as_json(people, ["aliases", "credits"]), "rec_no", "_json", PEOPLE_CHILDREN).withColumn("src", F.lit("people")),
        flatten_json(_as_json(shows, ["seasons"]), "rec_no", "_json", SHOW_CHILDREN).withColumn("src", F.lit("shows")),
    ]
    return parts[0].unionByName(parts[1]).select("src", "rec_no", "child", "pos", "subpos", "value")


def flat_table(elements: DataFrame, child: str, schema: T.StructType) -> DataFrame:
    """The child's flat table: rec_no, pos, subpos and the fields of `schema`; arrays inside an element are left to their own child."""
    rows = elements.where(F.col("child") == child).select("rec_no", "pos", "subpos", F.from_json("value", schema).alias("_v"))
    return rows.select("rec_no", "pos", "subpos", "_v.*")
