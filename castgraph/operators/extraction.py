"""Credits read out of wikitext, descriptions, pages and episode notes: rows (name, role, character) of each text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph.functions import text

# How the fields of infoboxes map to roles, and labels found in texts.
FIELD_ROLES = {
    "gm": "GM/DM", "dm": "GM/DM", "game_master": "GM/DM", "dungeon_master": "GM/DM", "dungeon_mistress": "GM/DM", "game_mistress": "GM/DM", "gamemaster": "GM/DM", "game_master_s": "GM/DM",
    "guest_gm": "guest GM", "guest_dm": "guest GM", "players": "player", "starring": "player", "cast": "player", "guest_players": "guest player", "guests": "guest player", "sguests": "guest player",
    "special_guests": "guest player", "special_guest(s)": "guest player", "guest(s)": "guest player", "guest_player": "guest player", "host": "host", "hostp": "host", "producer": "producer",
    "produced_by": "producer", "editor": "editor", "edited_by": "editor", "intro_edited_by": "editor", "writer": "writer", "written_by": "writer", "composer": "composer", "intro_music_by": "composer", "hosted_by": "host",
}
# End of fixed values.

Credit = tuple[str, str, str | None]
_name = re.compile(r"[^\W\d_][\w'’.\-]*(?: (?:\"[^\"]+\"|[^\W\d_][\w'’.\-]*)){1,3}")
_label = re.compile(r"^\s*(?:(?P<gm>dungeon master|game master|gm|dm|storyteller|keeper|referee)|(?P<guest>guest(?: star| player)?s?)|(?P<player>players?|cast|starring|featuring|with))\s*[:\-–—]\s*(?P<rest>.+)$", re.I)
_prose = re.compile(r"\b(?:takes|plays|joins|presents|with|and|the|for|from)\b", re.I)
_heading = re.compile(r"^\s*(?:the )?(?:cast|players|our players|starring|cast and crew|meet the cast)\s*:?\s*$", re.I)
_pair = re.compile(r"^\s*[•*\-–]?\s*(?P<a>[^:|–—]+?)\s*(?:\bas\b|[–—|]|\bplays\b|\bis playing\b| - )\s*(?P<b>.+?)\s*$")


def template(wikitext: str, prefix: str) -> str | None:
    """The first template whose name begins with the prefix, its braces matched; blanks and underscores are the same."""
    start = re.search(r"\{\{\s*" + re.escape(prefix).replace(r"\ ", "[ _]").replace("_", "[ _]"), wikitext, re.I)
    if not start:
        return None
    depth = 0
    for mark in re.compile(r"\{\{|\}\}").finditer(wikitext, start.start()):
        depth += 1 if mark.group() == "{{" else -1
        if depth == 0:
            return wikitext[start.start() : mark.end()]
    return None


def parameters(source: str) -> dict[str, str]:
    """Named parameters of a template, keys in lower case, the last of a name winning; pipes inside links and templates don't part."""
    inner, parts, depth, last = source[2:-2], [], 0, 0
    for mark in re.finditer(r"\{\{|\[\[|\}\}|\]\]|\|", inner):
        if mark.group() == "|":
            if depth == 0:
                parts.append(inner[last : mark.start()])
                last = mark.end()
        else:
            depth += 1 if mark.group() in ("{{", "[[") else -1
    parts.append(inner[last:])
    out = {}
    for part in parts[1:]:
        key, equals, value = part.partition("=")
        if equals:
            out[key.strip().lower().replace(" ", "_")] = value.strip()
    return out


def links_in_order(value: str) -> list[tuple[int, str, str]]:
    """(offset, target, label) of each wiki link."""
    return [(m.start(), m.group(1).strip(), (m.group(2) or m.group(1)).strip()) for m in re.finditer(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", value)]


def _plain_value(value: str) -> str:
    value = re.sub(r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", "", value, flags=re.S | re.I)
    value = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", value)
    value = re.sub(r"\{\{[^{}|]*\|([^{}]*)\}\}", lambda m: "\n".join(p for p in m.group(1).split("|") if "=" not in p), value)  # a template's own parts
    return re.sub(r"'{2,}", "", re.sub(r"<br\s*/?>", "\n", value, flags=re.I))


def people_of_value(value: str) -> list[tuple[str, str | None]]:
    """(name, character) of an infobox value: one person a line or list item, "X as Y" or "X (Y)" giving the character."""
    out, seen = [], set()
    for line in re.split(r"\n|;|(?<!\()\s*,\s*(?![^(]*\))", re.sub(r"<[^>]+>", " ", _plain_value(value))):
        line = line.strip(" *•\t")
        if not line:
            continue
        match = re.match(r"^(.+?)\s+(?:as|–|—)\s+(.+)$", line) or re.match(r"^(.+?)\s*\(([^)]+)\)$", line)
        name, character = (match.group(1).strip(), match.group(2).strip()) if match else (line, None)
        if name.lower() not in seen:
            seen.add(name.lower())
            out.append((name, character))
    return out


def credits_of_infobox(wikitext: str, prefix: str = "infobox") -> list[Credit]:
    found = template(wikitext, prefix)
    return [(name, FIELD_ROLES[key], character) for key, value in (parameters(found) if found else {}).items() if key in FIELD_ROLES for name, character in people_of_value(value)]


def _names(value: str) -> list[str]:
    return [m.group().strip() for part in re.split(r",|;|\band\b|&", value) if (m := _name.fullmatch(part.strip(" .\t")))]


def _headed(lines: list[str], window: int | None) -> list[Credit]:
    """Rows under each cast heading, to the next heading, the end or the end of the window; blank lines are skipped.

    After a blank line, where prose may follow, no word of prose makes a name, and one without a part has words in capitals only.
    """
    out: list[Credit] = []
    start, rows, apart = None, 0, False
    for i, line in enumerate(lines):
        if _heading.match(line):
            start, rows, apart = i, 0, False
        elif start is None or (window is not None and i > start + window):
            continue
        elif not line.strip():
            apart = rows > 0
        else:
            rows += 1
            pair = _pair.match(line)
            name = (pair.group("a") if pair else line).strip(" •*-–\t")
            if _name.fullmatch(name) and not (apart and (_prose.search(name) or not (pair or all(w.lstrip('"')[0].isupper() for w in name.split())))):
                out.append((name, "player", pair.group("b") if pair else None))
    return out


def credits_of_description(description: str, window: int | None = None) -> list[Credit]:
    """The first of three readings with more than one credit: lists under cast headings, labelled lines, pairs of performer and part.

    `window` is the most lines read under a heading; without one all are.
    """
    lines = description.splitlines()
    headed = _headed(lines, window)
    labelled = [(n, "GM/DM" if m["gm"] else "guest player" if m["guest"] else "player", None) for line in lines if (m := _label.match(line)) for n in _names(m["rest"])]
    paired = [(m["a"].strip(), "player", m["b"].strip()) for line in lines if (m := _pair.match(line)) and _name.fullmatch(m["a"].strip()) and len(m["b"]) < 60]
    for found in (headed, labelled, paired):
        if len({n.lower() for n, _, _ in found}) > 1:
            return list({n.lower(): (n, r, c) for n, r, c in reversed(found)}.values())[::-1]
    return []


def credits_of_notes(notes: str) -> list[Credit]:
    """Performer and part lines of episode notes; a line that says guest makes a guest player."""
    out = []
    for line in notes.splitlines():
        match = _pair.match(line)
        if match and _name.fullmatch(match["a"].strip()):
            out.append((match["a"].strip(), "guest player" if "guest" in line.lower() else "player", match["b"]))
    return out


def common_title(titles: list[str]) -> str:
    """The longest run of whole words that all titles begin with, up to a word that counts episodes."""
    out = []
    for words in zip(*[t.split() for t in titles]):
        if len(set(words)) > 1 or re.match(r"(?i)^(episode|ep|part|session|chapter|season|s\d+|#?\d+)\b", words[0]):
            break
        out.append(words[0])
    return " ".join(out).strip(" -–—:|,")


def extract(rows: DataFrame, key: str, column: str, read: Callable[[str], list[Credit]]) -> DataFrame:
    """(key, seq, name, role, character): the credits `read` finds in each text; null texts give none."""
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, seq int, name string, role string, character string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(k, i, *credit) for k, value in zip(part[key], part[column]) for i, credit in enumerate(read(value))]
            yield pd.DataFrame(found, columns=[key, "seq", "name", "role", "character"])

    return rows.where(F.col(column).isNotNull()).select(key, column).mapInPandas(run, schema)


def extract_from_html(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Credits of pages: their text lines are made in the JVM, then read like a description, 60 lines under a heading."""
    return extract(pages.withColumn("_lines", text.html_lines(html)), key, "_lines", partial(credits_of_description, window=60))
