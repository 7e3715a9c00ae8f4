"""Queries of uniqueness, integrity, schema rules and the audit, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph import model
from castgraph.operators import audit, integrity
from castgraph.operators import relations as rel
from castgraph.plans.views import Tables, sql_of
from castgraph.session import cut

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql_of(sql)
        return f

    return add


@query("SELECT 'people' AS kind, id, count(*) - 1 AS n_extra FROM people WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'shows', id, count(*) - 1 FROM shows WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def duplicate_ids(t: Tables) -> DataFrame:
    parts = [integrity.duplicate_ids(t.get(kind)).select(F.lit(kind).alias("kind"), "id", "n_extra") for kind in ("people", "shows")]
    return parts[0].unionByName(parts[1])


@query("SELECT rec_no, CAST(p - 1 AS INTEGER) AS pos, channels[p] AS channel FROM (SELECT rec_no, channels, unnest(range(1, len(channels) + 1)) AS p FROM cs) c WHERE channels[p] IS NOT NULL AND channels[p] NOT IN (SELECT id FROM main.channels)")
def dangling_channels(t: Tables) -> DataFrame:
    return integrity.dangling_channels(t.shows, t.channels).select("rec_no", "pos", "channel")


@query(
    """, has AS (SELECT show, string_agg(CAST(ordinal AS VARCHAR), ', ' ORDER BY pos) AS available FROM se GROUP BY show)
    SELECT c.rec_no, CAST(c.pos AS INTEGER) AS pos, c.show, c.season, h.available FROM cr c LEFT JOIN has h ON h.show = c.show
    WHERE c.season IS NOT NULL AND c.show IN (SELECT id FROM cs) AND NOT EXISTS (SELECT 1 FROM se WHERE se.show = c.show AND se.ordinal = c.season)"""
)
def dangling_seasons(t: Tables) -> DataFrame:
    return integrity.dangling_seasons(t.credits, t.seasons, t.shows).select("rec_no", "pos", "show", "season", "available")


@query("SELECT rec_no, CAST(pos AS INTEGER) AS pos, show FROM cr WHERE show IS NOT NULL AND show NOT IN (SELECT id FROM cs)")
def dangling_shows(t: Tables) -> DataFrame:
    refs = t.credits.where("show IS NOT NULL").select("rec_no", "pos", "show")
    return refs.join(t.shows.select(F.col("id").alias("show")), "show", "left_anti")


@query(
    r"""SELECT name_key, string_agg(person, '|' ORDER BY person) AS people, CAST(count(*) AS INTEGER) AS n_people FROM (SELECT DISTINCT trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS name_key, person
    FROM al WHERE name IS NOT NULL) WHERE name_key <> '' GROUP BY name_key HAVING count(*) >= 2"""
)
def shared_names(t: Tables) -> DataFrame:
    return integrity.shared_names(t.aliases)


_SLUG = "'^[a-z0-9]+(-[a-z0-9]+)*$'"
_DATE = r"'^\d{4}(-\d{2}(-\d{2})?)?$'"
_NN = "lambda x: x IS NOT NULL"


def _any(array: str, test: str) -> str:
    return f"coalesce(len(list_filter(list_filter({array}, {_NN}), lambda x: coalesce({test}, false))), 0) > 0"


def _in(values: list[str]) -> str:
    return "('" + "','".join(values) + "')"


def _source(test: str) -> str:
    return f"len(list_filter(list_filter(coalesce(x.sources, []), lambda s: s IS NOT NULL), lambda s: coalesce({test}, false))) > 0"


_URLS = "list_transform(list_filter(list_filter(coalesce(x.sources, []), lambda s: s IS NOT NULL), lambda s: s.url IS NOT NULL), lambda s: regexp_replace(lower(trim(s.url)), '/$', ''))"
_NAMES, _IDS = "list_transform(aliases, lambda a: a.name)", "list_filter(list_transform(aliases, lambda a: a.id), lambda i: i IS NOT NULL)"
_ORDINALS = "list_filter(list_transform(seasons, lambda s: s.ordinal), lambda o: o IS NOT NULL)"
PERSON_SQL = {
    "required": "id IS NULL OR coalesce(canonical_name, '') = ''",
    "slug": f"NOT regexp_matches(id, {_SLUG})",
    "qid": r"NOT regexp_matches(wikidata_qid, '^Q[1-9]\d*$')",
    "fair_use_rationale": "image.licence = 'fair use' AND coalesce(image.rationale, '') = ''",
    "alias_ids_unique": f"len({_IDS}) <> len(list_distinct({_IDS}))",
    "canonical_among_aliases": f"canonical_name IS NOT NULL AND NOT coalesce(list_contains({_NAMES}, canonical_name), false)",
    "alias_type": _any("aliases", f"x.alias_type NOT IN {_in(model.ALIAS_TYPES)}"),
    "alias_dates": _any("aliases", f"NOT regexp_matches(x.active_from, {_DATE}) OR NOT regexp_matches(x.active_to, {_DATE})"),
    "credit_role": _any("credits", f"x.role NOT IN {_in(model.CREDIT_ROLES)}"),
    "credit_year": _any("credits", f"NOT regexp_matches(x.year, {_DATE})"),
    "credit_season_positive": _any("credits", "x.season <= 0"),
    "credit_sources": _any("credits", "coalesce(len(x.sources), 0) = 0"),
    "episode_needs_season": _any("credits", "x.episode IS NOT NULL AND x.season IS NULL"),
    "url_cited_twice": _any("credits", f"len({_URLS}) <> len(list_distinct({_URLS}))"),
    "guest_needs_detail": _any("credits", "x.role IN ('guest player', 'guest GM') AND x.episode IS NULL AND x.note IS NULL"),
    "source_tier": _any("credits", _source(f"s.tier NOT IN {_in(model.TIERS)}")),
    "source_needs_evidence": _any("credits", _source("coalesce(s.url, '') = '' AND coalesce(s.note, '') = ''")),
    "attested_tier": _any("credits", _source("s.tier IN ('firsthand', 'participant') AND s.attested_by IS NULL")),
    "recording_locator": _any("credits", _source("s.tier = 'recording' AND coalesce(s.locator, s.url) IS NULL")),
}
SHOW_SQL = {
    "required": "id IS NULL OR coalesce(title, '') = ''",
    "slug": f"NOT regexp_matches(id, {_SLUG})",
    "has_channel": "coalesce(len(channels), 0) = 0",
    "format": f"format NOT IN {_in(model.FORMATS)}",
    "status": f"status NOT IN {_in(model.STATUSES)}",
    "fair_use_rationale": "image.licence = 'fair use' AND coalesce(image.rationale, '') = ''",
    "season_ordinals_unique": f"len({_ORDINALS}) <> len(list_distinct({_ORDINALS}))",
    "season_ordinal_positive": _any("seasons", "x.ordinal <= 0 OR x.episode_count <= 0"),
    "season_dates": _any("seasons", f"NOT regexp_matches(x.started, {_DATE}) OR NOT regexp_matches(x.ended, {_DATE})"),
}


def _rules_sql(source: str, rules: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT rec_no, '{name}' AS rule FROM {source} WHERE coalesce({test}, false)" for name, test in rules.items())


@query(_rules_sql("people", PERSON_SQL))
def person_violations(t: Tables) -> DataFrame:
    return integrity.violations(t.get("people"), integrity.person_rules()).select("rec_no", "rule")


@query(_rules_sql("shows", SHOW_SQL))
def show_violations(t: Tables) -> DataFrame:
    return integrity.violations(t.get("shows"), integrity.show_rules()).select("rec_no", "rule")


@query("SELECT rec_no FROM shows WHERE NOT (" + " OR ".join(f"coalesce({test}, false)" for test in SHOW_SQL.values()) + ")")
def good_shows(t: Tables) -> DataFrame:
    return integrity.good_records(t.get("shows"), integrity.show_rules()).select("rec_no")


_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(canonical_name)), '\b(jr|sr|ii|iii|iv|wwe superstar|dr|mr|ms|mrs)\b', ' ', 'g'), '[^a-z ]', '', 'g'), '\s+', ' ', 'g'))"


@query(
    rf""", k AS (SELECT DISTINCT id, w[1] AS first, w[-1] AS last FROM (SELECT id, string_split({_KEY}, ' ') AS w FROM cp WHERE canonical_name IS NOT NULL) WHERE len(w) >= 2)
    SELECT DISTINCT a.id AS a, b.id AS b FROM k a JOIN k b ON a.last = b.last AND a.id < b.id
    WHERE a.first = b.first OR (length(a.first) >= 3 AND length(b.first) >= 3 AND (starts_with(a.first, b.first) OR starts_with(b.first, a.first)))"""
)
def same_person_pairs(t: Tables) -> DataFrame:
    return integrity.same_person_pairs(t.people)


def _default_game(seasons: DataFrame) -> str | None:
    """The game most seasons are recorded with: what an importer puts where it knows nothing."""
    most = seasons.select(F.explode("game").alias("game")).where("game IS NOT NULL").groupBy("game").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "game").limit(1).collect()
    return most[0]["game"] if most else None


def findings(t: Tables) -> DataFrame:
    # The rules read the current records many times: they are chosen and flattened once, with the columns that some rule reads.
    people = cut(t.people.select("id", "rec_no", "canonical_name", "wikidata_qid", "image", "credits"))
    shows = cut(t.shows.select("id", "rec_no", "title", "description", "solo", "links", "channels", "seasons"))
    credits = cut(rel.credits(people).select("person", "rec_no", "pos", "show", "season", "episode", "role", "character", "note"))
    seasons = cut(rel.seasons(shows).select("show", "ordinal", "game"))
    parts = [
        audit.characters_as_people(people), audit.character_is_person(credits, people), audit.companies(people), audit.markup(people), audit.person_shaped_titles(shows, credits),
        audit.empty_seasons(shows, seasons, credits), audit.lone_credits(credits), audit.no_game_master(credits, seasons, t.games), audit.master_and_player(credits),
        audit.shared_characters(credits), audit.contradicted_systems(shows, seasons, t.games), audit.split_titles(shows), audit.out_of_scope(shows), audit.instructional(shows),
        audit.other_system_named(shows, seasons, t.games), audit.defaulted_system(shows, seasons, _default_game(seasons), more_than=0), audit.channels_without_shows(t.channels, shows), audit.twice_recorded(people),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("SELECT 'medium' AS severity, 'one credit in a season' AS what, show || ':' || CAST(season AS VARCHAR) AS subject FROM cr WHERE season IS NOT NULL AND show IS NOT NULL GROUP BY show, season HAVING count(*) = 1")
def lone_credits(t: Tables) -> DataFrame:
    return audit.lone_credits(t.credits)


@query(
    """, s AS (SELECT DISTINCT show, ordinal FROM se), c AS (SELECT DISTINCT show, season FROM cr WHERE season IS NOT NULL),
    n AS (SELECT s.show, count(*) AS n, count(c.season) AS cited FROM s LEFT JOIN c ON c.show = s.show AND c.season = s.ordinal GROUP BY s.show)
    SELECT CASE WHEN cited = 0 THEN 'medium' ELSE 'low' END AS severity, 'seasons without credits' AS what, show AS subject FROM n WHERE cited < n AND show NOT IN (SELECT id FROM cs WHERE solo)"""
)
def empty_seasons(t: Tables) -> DataFrame:
    return audit.empty_seasons(t.shows, t.seasons, t.credits)


@query(
    """, g AS (SELECT s.show, s.ordinal, bool_and(coalesce(games.gm_less, false)) AS less FROM (SELECT show, ordinal, unnest(game) AS game FROM se) s JOIN games ON games.id = s.game GROUP BY s.show, s.ordinal)
    SELECT 'low' AS severity, 'no game master' AS what, c.show || ':' || CAST(c.season AS VARCHAR) AS subject
    FROM (SELECT show, season FROM cr WHERE season IS NOT NULL AND show IS NOT NULL GROUP BY show, season HAVING count(*) >= 3 AND NOT coalesce(bool_or(contains(role, 'GM')), false)) c
    LEFT JOIN g ON g.show = c.show AND g.ordinal = c.season AND g.less WHERE g.show IS NULL"""
)
def no_game_master(t: Tables) -> DataFrame:
    return audit.no_game_master(t.credits, t.seasons, t.games)


@query(
    """SELECT 'medium' AS severity, 'runs and plays' AS what, person || ':' || show || ':' || coalesce(CAST(season AS VARCHAR), 'show') AS subject FROM cr WHERE show IS NOT NULL
    GROUP BY person, show, season HAVING bool_or(contains(role, 'GM')) AND bool_or(contains(role, 'player')) AND count(note) = 0"""
)
def master_and_player(t: Tables) -> DataFrame:
    return audit.master_and_player(t.credits)


@query(
    """SELECT 'high' AS severity, 'one character, several people' AS what, show || ':' || coalesce(CAST(season AS VARCHAR), 'show') || ':' || coalesce(episode, '') || ':' || part AS subject
    FROM (SELECT *, lower(trim(character)) AS part FROM cr WHERE contains(role, 'player') AND show IS NOT NULL) WHERE part <> '' GROUP BY show, season, episode, part HAVING count(DISTINCT person) >= 2 AND NOT bool_and(note IS NOT NULL)"""
)
def shared_characters(t: Tables) -> DataFrame:
    return audit.shared_characters(t.credits)


@query(
    r"""SELECT DISTINCT 'medium' AS severity, 'split by season' AS what, key AS subject FROM (SELECT key, c, count(DISTINCT id) AS n FROM (SELECT id, trim(regexp_replace(regexp_replace(lower(title), '\bseason\s*\d+\b|\bs\d+\b', '', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key, unnest(list_distinct(channels)) AS c FROM cs)
    WHERE key <> '' AND c IS NOT NULL GROUP BY key, c) WHERE n >= 2"""
)
def split_titles(t: Tables) -> DataFrame:
    return audit.split_titles(t.shows)


@query("SELECT DISTINCT 'high' AS severity, 'character is a person' AS what, person || ':' || part AS subject FROM (SELECT person, unnest(string_split(lower(character), ' / ')) AS part FROM cr) c JOIN cp ON lower(cp.canonical_name) = c.part AND contains(trim(cp.canonical_name), ' ') WHERE cp.id <> c.person")
def character_is_person(t: Tables) -> DataFrame:
    return audit.character_is_person(t.credits, t.people)


@query("SELECT 'high' AS severity, 'instructional title' AS what, id AS subject FROM cs WHERE regexp_matches(title, '" + audit.INSTRUCTIONAL + "')")
def instructional_titles(t: Tables) -> DataFrame:
    return audit.instructional(t.shows)


_q = lambda s: "'" + s.replace("'", "''") + "'"
_words = lambda c: f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"
_GAMES = f""", gk AS (SELECT key, min(name) AS name, list(DISTINCT id) AS ids FROM (SELECT id, name, {_words('name')} AS key FROM games WHERE length(name) >= 6) WHERE key <> '' GROUP BY key),
    recorded AS (SELECT show, list(DISTINCT g) AS games FROM (SELECT show, unnest(game) AS g FROM se) WHERE g IS NOT NULL GROUP BY show)"""


@query(f"SELECT 'high' AS severity, 'character as a person' AS what, id AS subject FROM cp WHERE len(credits) = 1 AND wikidata_qid IS NULL AND image IS NULL AND CASE WHEN regexp_matches(canonical_name, {_q(audit.PERSON_NAME)}) THEN len(regexp_split_to_array(canonical_name, '\\s+')) > 4 ELSE regexp_matches(canonical_name, {_q(audit.CHARACTER_NAME)}) END")
def characters_as_people(t: Tables) -> DataFrame:
    return audit.characters_as_people(t.people)


@query(f"SELECT 'high' AS severity, 'company name' AS what, id AS subject FROM cp WHERE regexp_matches(canonical_name, {_q(audit.COMPANY_WORD)})")
def company_names(t: Tables) -> DataFrame:
    return audit.companies(t.people)


@query(f"SELECT 'high' AS severity, 'markup in a name' AS what, id AS subject FROM cp WHERE regexp_matches(canonical_name, {_q(audit.MARKUP)})")
def names_with_markup(t: Tables) -> DataFrame:
    return audit.markup(t.people)


@query(f"SELECT 'medium' AS severity, 'title like a person' AS what, id AS subject FROM cs WHERE regexp_matches(title, {_q(audit.PERSON_SHAPED)}) AND links.podcast IS NULL AND links.youtube IS NULL AND id NOT IN (SELECT show FROM cr WHERE show IS NOT NULL)")
def person_shaped_titles(t: Tables) -> DataFrame:
    return audit.person_shaped_titles(t.shows, t.credits)


@query(_GAMES + f""" SELECT 'high' AS severity, 'title contradicts system' AS what, n.show || ':' || n.name AS subject FROM (SELECT cs.id AS show, min(gk.name) AS name, arg_min(gk.ids, gk.name) AS ids FROM cs JOIN gk ON contains(' ' || {_words('cs.title')} || ' ', ' ' || gk.key || ' ') GROUP BY cs.id) n
    JOIN recorded r ON r.show = n.show WHERE len(list_filter(r.games, lambda g: NOT list_contains(n.ids, g))) > 0""")
def contradicted_systems(t: Tables) -> DataFrame:
    return audit.contradicted_systems(t.shows, t.seasons, t.games)


@query(f"SELECT 'high' AS severity, 'description out of scope' AS what, id || ':' || hit AS subject FROM (SELECT id, lower(regexp_extract(description, {_q('(?i)(' + audit.OUT_OF_SCOPE + ')')}, 1)) AS hit FROM cs) WHERE hit <> ''")
def out_of_scope(t: Tables) -> DataFrame:
    return audit.out_of_scope(t.shows)


@query(_GAMES + f""" SELECT 'high' AS severity, 'description names another system' AS what, d.show || ':' || min(gk.name) AS subject FROM (SELECT id AS show, ' ' || {_words('description')} || ' ' AS said FROM cs WHERE description IS NOT NULL) d JOIN gk ON contains(said, ' ' || gk.key || ' ')
    LEFT JOIN recorded r ON r.show = d.show WHERE NOT coalesce(len(list_filter(r.games, lambda g: len(list_filter(gk.ids, lambda i: starts_with(g, i) OR starts_with(i, g))) > 0)) > 0, false) GROUP BY d.show""")
def other_system_named(t: Tables) -> DataFrame:
    return audit.other_system_named(t.shows, t.seasons, t.games)


@query("""SELECT 'medium' AS severity, 'defaulted system' AS what, CAST(count(*) AS VARCHAR) AS subject FROM cs WHERE NOT coalesce(starts_with(description, 'System per source'), false) AND id IN (SELECT show FROM se GROUP BY show
    HAVING bool_and(coalesce(list_distinct(game) = [(SELECT g FROM (SELECT unnest(game) AS g FROM se) WHERE g IS NOT NULL GROUP BY g ORDER BY count(*) DESC, g LIMIT 1)], false))) HAVING count(*) > 0""")
def defaulted_system(t: Tables) -> DataFrame:
    return audit.defaulted_system(t.shows, t.seasons, _default_game(t.seasons), more_than=0)


def _part(name: str) -> str:
    """The SQL of a query without the relations all queries share."""
    return ORACLE[name][len(sql_of("")) :]


_PARTS = ["characters_as_people", "character_is_person", "company_names", "names_with_markup", "person_shaped_titles", "empty_seasons", "lone_credits", "no_game_master", "master_and_player", "shared_characters",
          "contradicted_systems", "split_titles", "out_of_scope", "instructional_titles", "other_system_named", "defaulted_system"]
_OTHERS = {
    "channels_without_shows": "SELECT 'medium' AS severity, 'channel without shows' AS what, id AS subject FROM channels WHERE id NOT IN (SELECT unnest(channels) FROM cs WHERE channels IS NOT NULL)",
}


def _union() -> str:
    """All findings: each part's own relations are nested in it, so names don't clash."""
    nested = lambda sql: f"SELECT severity, what, subject FROM ({('WITH ' + sql.lstrip()[1:]) if sql.lstrip().startswith(',') else sql})"
    pairs = f"SELECT 'high' AS severity, 'probably the same person' AS what, a || ':' || b AS subject FROM ({'WITH ' + _part('same_person_pairs').lstrip()[1:]})"
    return " UNION ALL ".join([*(nested(_part(p)) for p in _PARTS), *_OTHERS.values(), pairs])


@query(_union())
def audit_findings(t: Tables) -> DataFrame:
    return findings(t)


@query(f"SELECT severity, what, count(*) AS n FROM ({_union()}) GROUP BY severity, what")
def audit_summary(t: Tables) -> DataFrame:
    return audit.summary(findings(t))


_COLLECTIONS_SQL = " UNION ALL ".join([
    f"SELECT 'people' AS collection, rec_no, rule AS problem FROM ({_rules_sql('people', PERSON_SQL)})", f"SELECT 'shows', rec_no, rule FROM ({_rules_sql('shows', SHOW_SQL)})",
])


@query(f"SELECT collection, rec_no, CAST(count(*) AS BIGINT) AS n_problems, string_agg(problem, '|' ORDER BY problem) AS problems FROM ({_COLLECTIONS_SQL}) GROUP BY collection, rec_no")
def problem_report(t: Tables) -> DataFrame:
    """The problems of each record together, as the report lists them by file."""
    return integrity.report(integrity.problems(t.get("people"), t.get("shows")))


@query(f"SELECT collection, count(DISTINCT rec_no) AS n_records, count(*) AS n_problems FROM ({_COLLECTIONS_SQL}) GROUP BY collection")
def gate(t: Tables) -> DataFrame:
    """What the gate would refuse, by collection; `integrity.checked` raises it."""
    return integrity.problems(t.get("people"), t.get("shows")).groupBy("collection").agg(F.count_distinct("rec_no").alias("n_records"), F.count(F.lit(1)).alias("n_problems"))


@query(
    r"""SELECT name_key, arg_max(name, (-rec_no, pos)) AS display FROM (SELECT trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g')) AS name_key, name, person, rec_no, pos FROM al WHERE name IS NOT NULL) WHERE name_key <> '' GROUP BY name_key HAVING count(DISTINCT person) >= 2"""
)
def shared_name_display(t: Tables) -> DataFrame:
    """How a name that several people have is shown: the last matching alias of the person recorded first."""
    return integrity.shared_display(t.aliases)
