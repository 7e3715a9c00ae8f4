"""Cutting oversized texts into pieces under a token limit, at natural boundaries and with an overlap.

For each text the least number of pieces is computed and equally long targets are placed; each target is snapped to the strongest
boundary near it (paragraph, then line, sentence, word end; of equals the nearest). Each piece but the first begins about
`overlap` tokens before its cut. When a piece exceeds the limit, one piece is added and all targets are placed anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph.llm import bpe

LIMIT, OVERLAP = 1024, 64
#: A cut may lie this share of a piece's length away from its target.
SLACK = 0.15
#: A word of the pattern with more tokens than this may itself be cut, into parts of about so many tokens.
LONGEST_WORD, PART = 32, 4

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n|[  ]")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")


def _fit(words: list[str], size: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words with the overlong ones cut, whether each begins inside a word, and the tokens of whole words at their first part."""
    if not len(size) or size.max() <= LONGEST_WORD:
        return words, np.zeros(len(words), dtype=bool), size
    out, inside, whole = [], [], []
    for w, n in zip(words, size.tolist()):
        step = max(1, len(w) * PART // n) if n > LONGEST_WORD else len(w)
        for i in range(0, len(w), step):
            out.append(w[i : i + step])
            inside.append(i > 0)
            whole.append(0 if i else n)
    return out, np.array(inside), np.array(whole)


def strengths(words: list[str], inside: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each word: 4 paragraph, 3 line, 2 sentence, 1 word, 0 within a word.

    White space belongs to the text before a boundary where the pattern makes it a word of its own.
    """
    kinds: dict[str, int] = {}
    own = np.zeros(len(words), dtype=np.int8)  # what the word ends: a line, a sentence
    blank = np.zeros(len(words), dtype=bool)
    spaced = np.zeros(len(words), dtype=bool)
    for i, w in enumerate(words):
        k = kinds.get(w)
        if k is None:
            space = w.isspace()
            k = (4 if _PARAGRAPH.search(w) else 3 if "\n" in w or "\r" in w else 1) if space else (2 if _SENTENCE.search(w) else 0)
            k = kinds[w] = k | (8 if space else 0) | (16 if w[:1].isspace() else 0)
        own[i], blank[i], spaced[i] = k & 7, bool(k & 8), bool(k & 16)
    out = np.zeros(len(words), dtype=np.int8)
    if len(words) > 1:
        before, here = own[:-1], ~blank[1:]
        lines = np.zeros(len(words), dtype=np.int8)
        lines[1:] = np.where(blank[:-1], before, 0)
        # Two runs of line ends in a row, as in "\n" before "\n": together they are a paragraph's end.
        twice = np.zeros(len(words), dtype=bool)
        twice[2:] = (lines[2:] >= 3) & blank[1:-1] & blank[:-2] & (own[:-2] >= 3)
        lines[twice] = 4
        ended = np.zeros(len(words), dtype=np.int8)
        ended[1:] = np.where((before == 2) & ~blank[:-1] & spaced[1:], 2, 0)
        word = np.zeros(len(words), dtype=np.int8)
        word[1:] = np.where(spaced[1:] | blank[:-1], 1, 0)
        out = np.maximum(np.maximum(lines, ended), word)
        out[1:][~here & (out[1:] < 3)] = 0  # white space stays with what it follows
    out[inside] = 0
    return out


def cut(size: np.ndarray, strength: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, fresh, end) of each piece in words: it spans start to end, and what is before fresh is overlap.

    `size` has the tokens of each word, none above the limit; a piece's tokens are their sum.
    """
    passed = np.concatenate([[0], np.cumsum(size)])
    total = int(passed[-1])
    if total <= limit:
        return [(0, 0, len(size))]
    step = limit - overlap
    count = 1 + -(-(total - limit) // step)
    while True:
        pieces = _place(passed, strength, total, count, limit, overlap)
        if pieces is not None:
            return pieces
        count += 1
        if count > len(size):
            return _greedy(passed, limit, overlap)


def _start(passed: np.ndarray, fresh: int, overlap: int) -> int:
    """The word at which a piece begins so that about `overlap` tokens, never more, precede fresh."""
    return int(np.searchsorted(passed, passed[fresh] - overlap, side="left"))


def _place(passed: np.ndarray, strength: np.ndarray, total: int, count: int, limit: int, overlap: int) -> list[tuple[int, int, int]] | None:
    even, pieces, fresh = total / count, [], 0
    slack = max(1.0, even * SLACK)
    for k in range(1, count + 1):
        start = _start(passed, fresh, overlap) if fresh else 0
        if k == count:
            end = len(passed) - 1
        else:
            target = k * even
            lo = max(fresh + 1, int(np.searchsorted(passed, target - slack, side="left")))
            hi = min(int(np.searchsorted(passed, min(target + slack, passed[start] + limit), side="right")) - 1, len(passed) - 2)
            if hi < lo:
                return None
            near = strength[lo : hi + 1]
            best = np.flatnonzero(near == near.max())
            end = lo + int(best[np.argmin(np.abs(passed[lo + best] - target))])
        if passed[end] - passed[start] > limit or end <= fresh:
            return None
        pieces.append((start, fresh, end))
        fresh = end
    return pieces


def _greedy(passed: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Where no even placing fits: each piece as long as may be."""
    pieces, fresh, last = [], 0, len(passed) - 1
    while fresh < last:
        start = _start(passed, fresh, overlap) if fresh else 0
        if passed[fresh + 1] - passed[start] > limit:
            start = fresh
        end = min(last, max(fresh + 1, int(np.searchsorted(passed, passed[start] + limit, side="right")) - 1))
        pieces.append((start, fresh, end))
        fresh = end
    return pieces


def _by_code_points(encoder: bpe.Encoder, text: str, limit: int, overlap: int) -> list[tuple[str, int, int, int]]:
    """Where tokens of words don't add up: pieces measured as they are, each the longest that halving finds to fit, cut at any code point."""

    def longest(begin: int, end: int, most: int, back: bool) -> int:
        """How many code points after `begin`, or before `end`, are at most so many tokens; at least one."""
        good, bad = 1, end - begin + 1
        while bad - good > 1:
            n = (good + bad) // 2
            good, bad = (n, bad) if encoder.count(text[end - n : end] if back else text[begin : begin + n]) <= most else (good, n)
        return good

    out, begin, fresh = [], 0, 0
    while fresh < len(text):
        end = begin + longest(begin, min(len(text), begin + 16 * limit), limit, False)
        if end <= fresh:
            begin = fresh
            continue
        out.append((text[begin:end], encoder.count(text[begin:end]), begin, fresh - begin))
        begin, fresh = end - longest(max(begin, end - 16 * overlap), end, overlap, True) if overlap else end, end
    return out


def split_text(encoder: bpe.Encoder, words: list[str], limit: int = LIMIT, overlap: int = OVERLAP, size: np.ndarray | None = None) -> list[tuple[str, int, int, int]]:
    """(piece, its tokens, code point at which it begins, code points of overlap) of one text given as its words, whose tokens may be given.

    A piece is encoded by itself: its last white space may join otherwise, and a cut word's parts do; such pieces are counted
    anew, and one that exceeds the limit makes the text be cut for a limit less by what it exceeds.
    """
    def tokens_of(words: list[str]) -> np.ndarray:
        numbers = encoder.numbers(words)
        return encoder.offsets[numbers + 1] - encoder.offsets[numbers]

    given = words
    size = tokens_of(words) if size is None else size
    words, inside, whole = _fit(words, size)
    size = size if words is given else tokens_of(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))])
    strength = strengths(words, inside)
    aim = limit
    while True:
        out, most = [], 0
        for start, fresh, end in cut(size, strength, aim, overlap):
            piece = "".join(words[start:end])
            tokens = int(whole[start:end].sum())
            if words[end - 1].isspace() or inside[start] or (end < len(words) and inside[end]):
                tokens = encoder.count(piece)
            most = max(most, tokens)
            out.append((piece, tokens, int(at[start]), int(at[fresh] - at[start])))
        if most <= limit:
            return out
        aim -= most - limit
        if aim <= limit // 2:
            return _by_code_points(encoder, "".join(words), limit, overlap)


def split_oversized(df: DataFrame, key: str, text: str, path: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, n_pieces, begins, overlap_chars, n_tokens, piece) of each text of more than `limit` tokens.

    piece_no counts from 0; begins is the code point of the text at which the piece begins, and its first overlap_chars code
    points end the piece before. Null, empty and short texts give no row: a text has never more tokens than bytes, so texts of
    at most `limit` bytes are passed over before they reach Python. Whole texts of any length are cut; a word longer than any
    piece is cut inside. Repeated rows give repeated pieces; other columns are ignored.
    """
    shared = bpe.share_vocabulary(df.sparkSession, path)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece_no int, n_pieces int, begins bigint, overlap_chars int, n_tokens int, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.worker_encoder(shared)
        for batch in batches:
            for a, texts in bpe.blocks(batch.column(1)):
                words = [encoder.split(t) for t in texts]
                each = np.fromiter(map(len, words), dtype=np.int64, count=len(texts))
                numbers = encoder.numbers([w for ws in words for w in ws])
                sizes = encoder.offsets[numbers + 1] - encoder.offsets[numbers]
                passed = np.concatenate([[0], np.cumsum(sizes)])
                ends = np.cumsum(each)
                tokens = passed[ends] - passed[ends - each]
                rows: list[tuple] = []
                owner: list[int] = []
                for i in np.flatnonzero(tokens > limit).tolist():
                    pieces = split_text(encoder, words[i], limit, overlap, sizes[ends[i] - each[i] : ends[i]])
                    owner += [a + i] * len(pieces)
                    rows += [(n, len(pieces), begins, over, count, piece) for n, (piece, count, begins, over) in enumerate(pieces)]
                if rows:
                    number, total, begins, over, count, piece = zip(*rows)
                    columns = [pa.array(number, pa.int32()), pa.array(total, pa.int32()), pa.array(begins, pa.int64()), pa.array(over, pa.int32()), pa.array(count, pa.int32()), pa.array(piece, pa.string())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *columns], names=[key, "piece_no", "n_pieces", "begins", "overlap_chars", "n_tokens", "piece"])

    return df.where(F.octet_length(text) > limit).select(F.col(key), F.col(text)).mapInArrow(run, schema)
