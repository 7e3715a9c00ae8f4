"""Casts as they are laid out in descriptions, archives, articles and catalogue pages: each reader gives (name, role, character) rows.

A line is first read for what it is (a heading, a link, a pair, a label), then readers decide by the order of lines.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import regex

from castgraph.functions import filters
from castgraph.operators import extraction
from castgraph.operators.merge import real_character

Credit = tuple[str, str, str | None]

# Words of headings, labels and links.
RUNNER = r"(?:the\s+)?(?:dungeon\s?master|game\s?master|dm|gm|storyteller|keeper|marshal|judge|referee|narrator)(?:\s+of\s+.+)?"
CAST_HEADING = re.compile(r"(?:the\s+)?(?:cast|starring|players?|featuring|party|our players|cast and crew|meet the cast)\s*:?", re.I)
RUNNER_HEADING = re.compile(r"(?:game\s?master|dungeon\s?master|storyteller|keeper|gm|dm)\s*:?", re.I)
SOCIAL = re.compile(r"(?:twitch|twitter|x|fb|facebook|ig|insta(?:gram)?|youtube|yt|bluesky|bsky|tiktok|patreon|discord|website|web|email|mastodon|threads)\s*[:@]", re.I)
LABELS = [
    (re.compile(r"guest\s+(?:dm|gm|dungeon master|game master)\b", re.I), "guest GM"), (re.compile(r"(?:dungeon master|game master|dm|gm|storyteller|keeper)\b", re.I), "GM/DM"),
    (re.compile(r"guest(?:\s+(?:player|star))?s?\b", re.I), "guest player"), (re.compile(r"(?:starring|cast|players?|featuring|with)\b", re.I), "player"), (re.compile(r"(?:produced by|producers?)\b", re.I), "producer"),
    (re.compile(r"(?:edited by|editors?)\b", re.I), "editor"), (re.compile(r"(?:music by|composers?)\b", re.I), "composer"), (re.compile(r"(?:written by|writers?)\b", re.I), "writer"), (re.compile(r"(?:hosted by|hosts?)\b", re.I), "host"),
]
PROSE_SECTION = re.compile(r"==+\s*(?:main cast|cast\s*&\s*crew|cast|players)[^=]*==+(.*?)(?=\n==|\Z)", re.I | re.S)
PROSE_RUNNER = re.compile(r"(?:\b[DG]M(?:ed|'d)?|\b(?:Dungeon|Game)[- ]Master(?:ed)?|\brun|\bhosted)\s+by\s+\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", re.I)
# End of fixed values.

_link = re.compile(r"[\s\-–—(]*https?://\S+\s*$", re.I)
_bullet = re.compile(r"^[\s\-–—*•]+|[\s.,;]+$")
_pair = re.compile(r"^(.+?)\s*(?:\s-\s|\s[–—]\s|\sas\s|\splays\s|:)\s*(.+)$", re.I)
_bracket = re.compile(r"^(.+?)\s*\(([^)]+)\)\s*:?$")
_runner = re.compile(RUNNER, re.I)


def _shape(source: str):
    """The shape of names of a source, for Python strings."""
    s = filters.NAME_SHAPES[source]
    never, always, outer = (regex.compile(p) if p else None for p in (s.never, s.always, s.outer))

    def fits(value: str) -> bool:
        value = value.strip()
        value = outer.sub("", value) if outer else value
        return bool(value) and s.least <= len(value) <= s.most and len(value.split()) <= s.words and not never.search(value) and (always is None or bool(always.search(value)))

    return fits


looks_like = {source: _shape(source) for source in filters.NAME_SHAPES}


@dataclass(frozen=True)
class Line:
    """A line read: what it is, and its two sides where it pairs a name with a part."""

    kind: str
    text: str
    left: str = ""
    right: str = ""


def read_lines(text: str) -> Iterator[Line]:
    for raw in text.splitlines():
        line = raw.strip()
        bare = _link.sub("", line).strip()
        if not line:
            continue
        if CAST_HEADING.fullmatch(line):
            yield Line("cast", line)
        elif RUNNER_HEADING.fullmatch(line):
            yield Line("runner", line)
        elif SOCIAL.match(line) or not bare:
            yield Line("link", line)
        elif len(bare) > 140:
            yield Line("prose", bare)
        elif (m := _bracket.match(bare)) or (m := _pair.match(bare)):
            yield Line("pair", bare, _bullet.sub("", m.group(1)), m.group(2).strip())
        else:
            yield Line("text", _bullet.sub("", bare))


def _credit(name: str, part: str) -> Credit:
    """A performer and a part: a part that runs the game is the role; what describes a part after a comma is no part of it."""
    part = re.split(r",\s*(?:an?\b|the\b)", part, flags=re.I)[0].strip()
    return (name, "GM/DM", None) if _runner.fullmatch(part) else (name, "player", real_character(part))


def under_headings(text: str) -> list[Credit]:
    """Pairs under every cast heading to the next one; a bare name under a heading of who runs the game."""
    out: list[Credit] = []
    section = None
    for line in read_lines(text):
        if line.kind in ("cast", "runner"):
            section = line.kind
        elif section == "runner" and line.kind == "text" and looks_like["description"](line.text):
            out.append((line.text, "GM/DM", None))
            section = None
        elif section and line.kind == "pair" and looks_like["description"](line.left):
            out.append(_credit(line.left, line.right))
    return out


def part_first(text: str) -> list[Credit]:
    """Lines "part: performer", which count once a line has said who runs the game."""
    out: list[Credit] = []
    for line in read_lines(text):
        if line.kind != "pair" or ":" not in line.text or not looks_like["description"](line.right):
            continue
        if RUNNER_HEADING.fullmatch(line.left):
            out.append((line.right, "GM/DM", None))
        elif out and not line.left[:1].isdigit() and len(line.left) >= 2:
            out.append((line.right, "player", line.left))
    return out


def labelled(text: str) -> list[Credit]:
    """Lines that begin with a role, followed by names, each perhaps with a part."""
    out: list[Credit] = []
    for raw in text.splitlines():
        line = raw.strip(" \t*•-–—")
        for label, role in LABELS:
            m = label.match(line)
            if m and re.match(r"\s*[:\-–—]\s*\S", line[m.end() :]) or m and line[: m.end()].lower().endswith(" by"):
                rest = re.sub(r"^\s*[:\-–—]\s*", "", line[m.end() :])
                for chunk in re.split(r",(?![^(]*\))|;|\s+and\s+|\s*&\s*", rest):
                    pair = re.match(r"^(.+?)\s+as\s+(.+)$", chunk.strip(), re.I) or _bracket.match(chunk.strip())
                    name = _bullet.sub("", pair.group(1) if pair else chunk)
                    if looks_like["description"](name) and not re.fullmatch(filters.JOB.replace("(?i)", ""), name, re.I):
                        out.append((name, role, real_character(pair.group(2)) if pair else None))
                break
    return out


def cast_of_description(text: str) -> list[Credit]:
    """The first layout with more than one credit: headings, parts first, labelled lines. One credit a person and role."""
    for read in (under_headings, part_first, labelled):
        kept: dict[tuple[str, str], Credit] = {}
        for name, role, part in read(text):
            if part and (re.search(filters.ADDRESS, part, re.I) or len(part) > 60):
                part = None
            if not re.fullmatch(filters.JOB.replace("(?i)", ""), name, re.I) and (kept.get((name.lower(), role)) or (0, 0, None))[2] is None:
                kept[name.lower(), role] = (name, role, part)
        if len(kept) > 1:
            return list(kept.values())
    return []


def cast_of_archive(text: str) -> list[Credit]:
    """Handles with their parts after an introduction of players, else the names after "starring"."""
    lines = [line.strip() for line in text.splitlines()]
    at = next((i for i, line in enumerate(lines) if re.search(r"\b(?:players?|cast)\s*(?:\bare\b|:)", line, re.I) or CAST_HEADING.fullmatch(line)), None)
    out: list[Credit] = []
    for line in lines[at + 1 :] if at is not None else ():
        if len(line) > 140:
            break
        m = re.match(r"^@?([\w.-]{2,30})\s*(?:\([^)]+\))?\s*[-–—:]\s*(.+)$", line)
        if m:
            part = m.group(2).strip()
            out.append((m.group(1), "GM/DM", None) if _runner.fullmatch(part) else (m.group(1), "player", real_character(part.split(",")[0])))
    if len(out) > 1:
        return out
    m = re.search(r"\bstarring\s+([^.\n]{4,200})", text, re.I)
    names = [n.strip() for n in re.split(r",|\band\b", m.group(1), flags=re.I)] if m else []
    found = [(n, "player", None) for n in names if n and looks_like["archive"](n)]
    return found if len(found) > 1 else []


def prose_cast(wikitext: str) -> list[Credit]:
    """The linked names of an article's cast section, each with what follows "as"; a part that runs the game is the role."""
    m = PROSE_SECTION.search(wikitext)
    out: list[Credit] = []
    for line in (m.group(1) if m else "").splitlines():
        link = re.search(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", line)
        if link:
            part = re.search(r"\bas\s+(.+)$", line[link.end() :], re.I)
            plain = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]|'{2,}", r"\1", part.group(1)).strip(" .") if part else ""
            out.append(_credit((link.group(2) or link.group(1)).strip(), plain))
    return out


def prose_runners(wikitext: str) -> list[str]:
    """Who runs the game by an article's prose, outside templates; each once."""
    return list(dict.fromkeys(m.group(1).strip() for m in PROSE_RUNNER.finditer(re.sub(r"\{\{.*?\}\}", " ", wikitext, flags=re.S))))


def cast_of_catalogue_page(page: str, title: str | None = None) -> list[Credit]:
    """Rows of a catalogue's cast list (a link with a name, then an element with the character); nothing if the page's heading is another title."""
    squeezed = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
    strip = lambda s: re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]+>", " ", s))).strip()
    heading = re.search(r"<h1[^>]*>(.*?)</h1>", page, re.S | re.I)
    if title and heading and squeezed(strip(heading.group(1))) != squeezed(title):
        return []
    out: list[Credit] = []
    for m in re.finditer(r'<a[^>]*href="[^"]*/(?:person|people)/[^"]*"[^>]*>(.*?)</a>(.*?)(?=<a[^>]*href="[^"]*/(?:person|people)/|</ol>|</ul>|\Z)', page, re.S | re.I):
        name = strip(m.group(1))
        if looks_like["catalogue"](name):
            part = re.search(r'<(\w+)[^>]*class="[^"]*(?:character|role)[^"]*"[^>]*>(.*?)</\1>', m.group(2), re.S | re.I)
            text = strip(part.group(2)) if part else ""
            runs = re.search(filters.RUNS_THE_GAME, text)
            out.append((name, "GM/DM" if runs else "player", None if runs else real_character(re.sub(r"(?i)^self\s*[,/-]\s*", "", text))))
    return out


def best_path(found: dict[str, list[Credit]], paths: list[str]) -> tuple[str, list[Credit]] | None:
    """Of the pages of a website the one with most credits, two at least; of equals the one whose path comes first."""
    ranked = [(-len(found[p]), i, p) for i, p in enumerate(paths) if len(found.get(p, ())) >= 2]
    return (min(ranked)[2], found[min(ranked)[2]]) if ranked else None


# Linked values of infoboxes: which links are performers and which their parts.

_as = re.compile(r"\bas\b|\s[-–—]\s", re.I)


@dataclass
class Cast:
    """A linked value read: performers with their parts, who of them runs the game, and links that are no person."""

    people: list[tuple[str, str | None, bool]]
    dropped: list[str]


def _links(value: str) -> list[tuple[int, int, str]]:
    """(start, end, name) of each link, without the prefix of another wiki; a shown label goes before the target."""
    return [(m.start(), m.end(), re.sub(r"^(?:[a-z][a-z0-9-]*:)+(?=\S)", "", (m.group(2) or m.group(1)).strip())) for m in re.finditer(r"\[\[([^\]|]+)(?:\|([^\]]*))?\]\]", value)]


def _slots(value: str) -> list[str]:
    """The positional parts of a template inside a value, in order, without separators of groups."""
    start = re.search(r"\{\{[A-Za-z]", value)
    if not start:
        return []
    depth, parts, last = 0, [], None
    for m in re.finditer(r"\{\{|\[\[|\}\}|\]\]|\|", value[start.start() :]):
        mark, at = m.group(), start.start() + m.start()
        if mark in ("{{", "[["):
            depth += 1
        elif mark == "|":
            if depth == 1:
                parts += [value[last:at]] if last is not None else []
                last = at + 1
        else:
            depth -= 1
            if not depth:
                parts += [value[last:at]] if last is not None else []
                break
    return [p.strip() for p in parts if "=" not in p and not re.fullmatch(r"-{2,}", p.strip())]


def _by_slots(value: str) -> list[tuple[str, str | None, bool]]:
    """A template's parts: performers only, if nearly every second part is empty, else performers and their parts in turn."""
    slots = _slots(value)
    while slots and not slots[0]:
        slots = slots[1:]
    filled, seconds = [s for s in slots if s], [s for s in slots[1::2] if s]
    if filled and len(seconds) <= len(filled) / 4:
        named = [(_links(s), s) for s in filled]
        return [(links[0][2] if links else s, None, False) for links, s in named if len(links) == 1 or not links and looks_like["page"](s) and " " in s]
    if not seconds or any(len(_links(s)) != 1 for s in slots[::2]):
        return []
    parts = slots[1::2] + [""] * (len(slots) % 2)
    return [(_links(s)[0][2], " / ".join(n for _, _, n in _links(p)) or None, bool(_runner.fullmatch(p.replace("[[", "").replace("]]", "").strip()))) for s, p in zip(slots[::2], parts)]


def _by_lines(lines: list[str], least: int) -> list[tuple[str, str | None, bool]]:
    """One performer a line, before "as" or a dash; the links after it are the part. Nothing if some line names several performers."""
    out = []
    for line in lines:
        links, at = _links(line), _as.search(line)
        before = [n for start, _, n in links if not at or start < at.start()]
        if len(before) != 1:
            return []
        out.append((before[0], " / ".join(n for start, _, n in links if at and start > at.start()) or None, bool(at and _runner.fullmatch(re.sub(r"\[\[|\]\]|'{2,}", "", line[at.end() :]).strip()))))
    return out if len(out) >= least else []


def linked_cast(value: str, kinds: dict[str, str] | None = None) -> Cast:
    """Who a linked value credits, by the first reading that fits: a template's parts, a list, lines that say "as", else link by link.

    Link by link a person opens an entry, a character belongs to the entry before, an organisation is dropped; a link of unknown kind after a
    performer without a part is the part.
    """
    kinds, links = kinds or {}, _links(value)
    bullets = [line for line in map(str.strip, value.splitlines()) if line.startswith("*") and "[[" in line]
    rows = [line for line in re.split(r"<br\s*/?>|\n", value, flags=re.I) if "[[" in line]
    found = _by_slots(value) or (_by_lines(bullets, 2) if len(bullets) > 1 else []) or (_by_lines(rows, 1) if _as.search(value) and len(links) > 1 else [])
    if found:
        return Cast(found, [])
    people: list[list] = []
    dropped = []
    for i, (_, end, name) in enumerate(links):
        kind = kinds.get(name, "unknown")
        if kind == "organisation":
            dropped.append(name)
        elif people and (kind == "character" or kind == "unknown" and people[-1][1] is None):
            people[-1][1] = f"{people[-1][1]} / {name}" if people[-1][1] else name
        elif kind != "character":
            after = value[end : links[i + 1][0] if i + 1 < len(links) else len(value)]
            people.append([name, None, any(_runner.fullmatch(t.strip(" ()'")) for t in re.split(r"[|,\n]|<br\s*/?>", after))])
    return Cast([tuple(p) for p in people], dropped)


def cast_of_infobox(wikitext: str, kinds: dict[str, str] | None = None, prefix: str = "infobox") -> tuple[list[Credit], list[str], list[str]]:
    """(credits, dropped links, unmapped fields) of a page: its infobox, else its cast section; who runs the game by prose where no field says so.

    A part that is a performer's page under another field's role stays with the performer; fields with links that map to no role are reported.
    """
    found = extraction.template(wikitext, prefix)
    fields = extraction.parameters(found) if found else {}
    credits: list[Credit] = []
    dropped, unmapped = [], []
    for key, value in fields.items():
        role = extraction.FIELD_ROLES.get(key)
        if role is None:
            unmapped += [key] if "[[" in value else []
        elif "[[" in value:
            cast = linked_cast(value, kinds)
            dropped += cast.dropped
            credits += [(name, "GM/DM" if runs else role, None if runs else part) for name, part, runs in cast.people]
        else:
            credits += [(name, role, part) for name, part in extraction.people_of_value(value)]
    credits = credits or prose_cast(wikitext)
    if not any(role == "GM/DM" for _, role, _ in credits):
        credits += [(name, "GM/DM", None) for name in prose_runners(wikitext)]
    return credits, dropped, unmapped
