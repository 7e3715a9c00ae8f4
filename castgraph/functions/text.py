"""Text functions as Spark columns: everything stays in the JVM's generated code."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and labels that results depend on.
BLANK = r"[\s\p{Z}\x{FEFF}]"
ROLE_LABEL = (
    r"(?i)^(actor|actress|self|host|guest|guest star|self\s*[-–—,]\s*\w+|narrator|announcer|storyteller|story teller|game ?master|dungeon ?master|gm|dm|keeper|marshall?|judge|referee|crew|player"
    r"|cast|various|additional voices)$"
)
LINK_LABELS = [
    (r"(?i)youtube\.com/playlist\?|[?&]list=", "Watch the playlist", "watch"),
    (r"(?i)youtube\.com/watch\?|youtu\.be/", "Watch on YouTube", "watch"),
    (r"(?i)youtube\.com/(@|c/|channel/|user/)", "YouTube channel", "home"),
    (r"(?i)youtube\.com", "YouTube", "home"),
    (r"(?i)twitch\.tv", "Watch on Twitch", "watch"),
    (r"(?i)archive\.org/details", "Watch on the Internet Archive", "watch"),
    (r"(?i)archive\.org", "Internet Archive", "watch"),
    (r"(?i)podcasts\.apple\.com", "Listen on Apple Podcasts", "listen"),
    (r"(?i)open\.spotify\.com|spotify\.com", "Listen on Spotify", "listen"),
    (r"(?i)podbean\.com|libsyn\.com|buzzsprout\.com|simplecast\.com|megaphone\.fm|anchor\.fm|creators\.spotify\.com|acast\.com|art19\.com", "Listen to the podcast", "listen"),
    (r"(?i)en\.wikipedia\.org", "Wikipedia", "read"),
    (r"(?i)wikidata\.org", "Wikidata", "read"),
    (r"(?i)fandom\.com|miraheze\.org|wikia\.", "Read the wiki", "read"),
    (r"(?i)beacon\.tv", "Watch on Beacon", "watch"),
    (r"(?i)dropout\.tv", "Watch on Dropout", "watch"),
]
OTHER_LINK = ("Official site", "home")
LINK_ORDER = {"watch": 0, "listen": 1, "home": 2, "read": 3}
# End of fixed values.


#: What plain YAML would read as something else than this text.
YAML_UNSAFE = r"^[\s\-?:,\[\]{}#&*!|>'\"%@`]|: | #|\s$|^$|(?i)^(true|false|null|yes|no|~|[-+.0-9][-+.0-9e_:]*)$"


def _accented() -> tuple[str, str]:
    """Latin letters that decompose into a plain letter and marks, and those plain letters, by the Unicode database."""
    pairs = []
    for p in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x212B]:
        base = unicodedata.normalize("NFD", chr(p))
        if len(base) > 1 and base[0].isascii() and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(p), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accented()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(c), f"^{BLANK}+|{BLANK}+$", "")


def strip_accents(c: Column | str) -> Column:
    """Without the accents of Latin letters and without combining marks; other letters stay."""
    return F.regexp_replace(F.translate(_col(c), _ACCENTED, _PLAIN), r"[\x{0300}-\x{036F}]", "")


def normal_name(c: Column | str) -> Column:
    """Name normaliser: no accents, lower case, one space for everything but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", " "))


def name_key(c: Column | str) -> Column:
    """Name key without generational suffixes and titles, letters only."""
    lower = F.lower(strip_accents(c))
    bare = F.regexp_replace(lower, r"(?<![a-z0-9_])(jr|sr|ii|iii|iv|wwe superstar|dr|mr|ms|mrs)(?![a-z0-9_])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z ]", ""), r"\s+", " "))


def nickname_free_key(c: Column | str) -> Column:
    """Name key without a quoted or bracketed nickname."""
    bare = F.regexp_replace(strip_accents(c), r"[\"“”'‘’(\[][^\"“”'‘’()\[\]]*[\"“”'‘’)\]]", " ")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))


def title_key(c: Column | str) -> Column:
    """Title key: no accents, & as and, no leading article, no punctuation."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "&", " and "), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(spaced, "^(the|a|an) ", ""))


def slug(c: Column | str, at_most: int | None = None, drop_after_pipe: bool = False, accents: bool = True) -> Column:
    """Slug of a text: lower case, hyphens for all else; optionally cut, and without what follows a pipe."""
    text = F.lower(strip_accents(c) if accents else _col(c))
    if drop_after_pipe:
        text = F.regexp_replace(text, r"(?s)\|.*$", "")
    text = F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(text, 1, at_most), "-+$", "") if at_most else text


def sort_name(c: Column | str) -> Column:
    """"Last, First…" of a name of more than one word."""
    words = F.split(trim(c), f"{BLANK}+")
    return F.when(F.size(words) < 2, trim(c)).otherwise(F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, 1, F.size(words) - 1), " ")))


def role_kind(c: Column | str) -> Column:
    """gm, player, or the role itself."""
    role = F.coalesce(_col(c), F.lit(""))
    return F.when(F.contains(role, F.lit("GM")) | F.contains(role, F.lit("DM")), "gm").when(F.contains(role, F.lit("player")), "player").otherwise(role)


def real_character(c: Column | str) -> Column:
    """The character, unless it is blank or a label of a role."""
    value = trim(c)
    return F.when((value != "") & ~value.rlike(ROLE_LABEL), value)


def url_host(c: Column | str) -> Column:
    """Host of a URL with a port other than its scheme's, in lower case, without www.; null if it is no URL."""
    url = _col(c)
    scheme, authority = F.lower(F.regexp_extract(url, r"(?i)^(https?|ftp)://", 1)), F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#\s]+)", 1))
    port = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    return F.nullif(F.regexp_replace(port, r"^www\.", ""), F.lit(""))


def origin_key(source: Column) -> Column:
    """What a source's independence is judged by: who attests it, else the host of its URL, else its note."""
    who, url = source["attested_by"], source["url"]
    return (
        F.when(F.coalesce(who, F.lit("")) != "", F.concat(F.lit("who:"), F.lower(trim(who))))
        .when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("where:"), F.coalesce(url_host(url), F.lower(url))))
        .otherwise(F.concat(F.lit("note:"), F.lower(trim(F.coalesce(source["note"], F.lit(""))))))
    )


def link_label(c: Column | str) -> Column:
    """struct(label, kind, host) of a link, by the first pattern that fits; null for what is no http URL."""
    url = _col(c)
    pick = lambda n: reduce(lambda case, p: case.when(url.rlike(p[0]), p[n]), LINK_LABELS[1:], F.when(url.rlike(LINK_LABELS[0][0]), LINK_LABELS[0][n])).otherwise(OTHER_LINK[n - 1])
    return F.when(url.rlike("(?i)^https?://") & url_host(url).isNotNull(), F.struct(pick(1).alias("label"), pick(2).alias("kind"), url_host(url).alias("host")))


def year_range(earliest: Column | str, latest: Column | str) -> Column:
    """The years between two partial dates as shown: one year if they are the same."""
    a, b = F.left(_col(earliest), F.lit(4)), F.left(_col(latest), F.lit(4))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, a).otherwise(F.concat(a, F.lit("–"), b))


def compact_count(c: Column | str) -> Column:
    """1.2M, 12K or the number; halves are rounded up."""
    n = _col(c)
    tenths = F.floor((n + 50_000) / 100_000)
    million = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""), F.lit("M"))
    return F.when(n >= 1_000_000, million).when(n >= 1000, F.concat(F.floor((n + 500) / 1000).cast("string"), F.lit("K"))).otherwise(n.cast("string"))


def html_lines(c: Column | str) -> Column:
    """Text of HTML: no script or style, a line for each block, entities decoded, blanks joined."""
    text = F.regexp_replace(_col(c), r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|td|ul|ol|section|article)>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#039;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\x{A0}]+", " "), r" *\n[ \n]*", "\n"))


def wikitext_plain(c: Column | str) -> Column:
    """Wikitext without references, tags, link brackets and bold marks."""
    text = F.regexp_replace(_col(c), r"(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>", "")
    text = F.regexp_replace(text, r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", "$1")
    text = F.regexp_replace(text, r"\[https?://\S+ ([^\]]*)\]", "$1")
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "'{2,}", "")
    return F.trim(F.regexp_replace(text, "[ \t]+", " "))


def without_interwiki(c: Column | str) -> Column:
    """A link's target without its interwiki prefix."""
    return F.regexp_replace(_col(c), r"^(?:[a-z][a-z0-9-]*:)+(?=\S)", "")


def playlist_id(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"[?&]list=([A-Za-z0-9_-]+)", 1), F.lit(""))


def archive_id(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c), r"archive\.org/details/([^/?#]+)", 1), F.lit(""))


def wiki_page(c: Column | str) -> Column:
    """struct(host, page) of a wiki URL."""
    return F.struct(url_host(c).alias("host"), F.nullif(F.regexp_extract(_col(c), r"/wiki/([^?#]+)", 1), F.lit("")).alias("page"))


def known(c: Column | str) -> Column:
    """Null for the catalogue's \\N and for empty text."""
    return F.when((_col(c) != "\\N") & (_col(c) != ""), _col(c))


def close(a: Column | str, b: Column | str, most: int = 2) -> Column:
    """Equal, one containing the other, or within `most` edits where lengths differ by at most most + 1."""
    x, y = _col(a), _col(b)
    near = (F.abs(F.length(x) - F.length(y)) <= most + 1) & (F.levenshtein(x, y, most) >= 0)
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x) | near)


def yaml_quoted(c: Column | str) -> Column:
    """A scalar for generated YAML, quoted where plain text would be read as something else."""
    text = _col(c)
    unsafe = text.rlike(YAML_UNSAFE)
    return F.when(unsafe, F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))).otherwise(text)


def candidate_hosts(c: Column | str, domains: list[str]) -> Column:
    """Wiki hosts that may belong to a name: its slug and its words joined, without an article or a generic ending, under each domain."""
    base = F.regexp_replace(title_key(c), r" (podcast|show|network|rpg|productions|studio|studios|media)$", "")
    stems = F.array_distinct(F.array(F.replace(base, F.lit(" "), F.lit("-")), F.replace(base, F.lit(" "), F.lit("")), F.regexp_replace(F.replace(title_key(c), F.lit(" "), F.lit("-")), "^-+|-+$", "")))
    hosts = F.flatten(F.transform(F.filter(stems, lambda s: s != ""), lambda s: F.array(*[F.concat(s, F.lit(f".{d}")) for d in domains])))
    return F.array_distinct(hosts)
