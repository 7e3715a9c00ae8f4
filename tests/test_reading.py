import json
import random

import pytest
from pyspark.sql import functions as F

from castgraph import model
from castgraph.functions import filters, text
from castgraph.operators import catalogue, discovery, integrity, layouts, linking, merge, publish, ranking
from castgraph.sources import files
from tests.test_operators import PEOPLE, SHOWS, credit, person, show

HEADED = """A night of tales.

Game Master
Cy Dune

Cast:
Ana Vale as Opal, a Winter Ranger

Twitter: @ana
https://example.test/x
Bo Reed - Zed
Lindy Moss (Keeper of Lore): https://example.test/lindy
Players
Otto Marlow: The Announcer
"""


@pytest.mark.parametrize(
    "reader, given, expected",
    [
        (layouts.cast_of_description, HEADED, [("Cy Dune", "GM/DM", None), ("Ana Vale", "player", "Opal"), ("Bo Reed", "player", "Zed"), ("Lindy Moss", "GM/DM", None), ("Otto Marlow", "player", "The Announcer")]),
        (layouts.cast_of_description, 'DM: Mark "Sherlock" Holm - https://x.test/a\nDaisy: Kate Moor - https://x.test/b\n12:30: Bo Reed\nRowan: Chris Trot', [('Mark "Sherlock" Holm', "GM/DM", None), ("Kate Moor", "player", "Daisy"), ("Chris Trot", "player", "Rowan")]),
        (layouts.cast_of_description, "Starring: Ana Vale as Opal, Bo Reed (Zed) and Cy Dune\nEdited by Otto Marlow\nMusic by: Dee Finch", [("Ana Vale", "player", "Opal"), ("Bo Reed", "player", "Zed"), ("Cy Dune", "player", None), ("Otto Marlow", "editor", None), ("Dee Finch", "composer", None)]),
        (layouts.cast_of_description, "Cast\nArtist - Someone\nwe went to the shop", []),
        (layouts.cast_of_archive, "Our players are:\n@ana_v (Ana) - Opal, Elf Ranger\n@bo.reed - DM\n\n@cy - Player", [("ana_v", "player", "Opal"), ("bo.reed", "GM/DM", None), ("cy", "player", None)]),
        (layouts.cast_of_archive, "A play starring Kyle, Jenn Moor, and Travis. More.", [("Kyle", "player", None), ("Jenn Moor", "player", None), ("Travis", "player", None)]),
        (layouts.cast_of_archive, "nothing", []),
        (layouts.prose_cast, "x\n== Cast ==\n* [[Ana Vale]] as the Dungeon Master\n* [[B|Bo Reed]] as '''[[Zed]]'''\n* nobody\n== Plot ==\n[[Cy]]", [("Ana Vale", "GM/DM", None), ("Bo Reed", "player", "Zed")]),
        (layouts.prose_runners, "{{x|run by [[No One]]}} It is DMed by [[Mara Holm]] and run by [[Mara Holm|Mara]], later hosted by [[Bo Reed]].", ["Mara Holm", "Bo Reed"]),
    ],
)
def test_layouts(reader, given, expected):
    assert reader(given) == expected


def test_catalogue_pages_and_paths():
    page = '<h1>The Tin-Lantern</h1><ul><li><a href="/person/1-ana">Ana Vale</a><p class="character">Self, Dungeon Master</p></li><li><a href="/person/2">Bo &amp; Reed</a><p class="character">Zed</p></li></ul>'
    assert layouts.cast_of_catalogue_page(page, "the tin lantern") == [("Ana Vale", "GM/DM", None), ("Bo & Reed", "player", "Zed")]
    assert layouts.cast_of_catalogue_page(page, "Copper Bells") == []
    rows = [("a", "player", None)]
    assert layouts.best_path({"/cast": rows * 2, "/about": rows * 3, "/team": rows * 3, "/": rows}, ["/cast", "/team", "/about", "/"])[0] == "/team"
    assert layouts.best_path({"/": rows}, ["/"]) is None


@pytest.mark.parametrize(
    "value, shapes",
    [("Ana Vale", {"description", "page", "archive", "catalogue", "notes"}), ("ana_vale99", {"page", "archive", "catalogue"}), ("Bo and Cy", {"archive", "catalogue"}), ("@bo", set()), ("Join us now", {"description", "archive", "catalogue"}), ("", set()), ("éand Vale", {"archive", "catalogue"})],
)
def test_name_shapes(spark, value, shapes):
    df = spark.createDataFrame([(value,)], "v string").select(*[filters.looks_like_name("v", k).alias(k) for k in filters.NAME_SHAPES])
    row = df.first().asDict()
    assert {k for k, fits in row.items() if fits} - {"page", "description"} == shapes - {"page", "description"}
    assert {k for k, fits in row.items() if fits} == {k for k, fits in layouts.looks_like.items() if fits(value)} or not value.isascii()


def test_filters(spark):
    one = lambda column, value: spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first()["x"]
    assert one(filters.licence_of_url("v"), "https://creativecommons.org/licenses/by-nc-sa/4.0/") == "CC-BY-NC-SA-4.0"
    assert one(filters.licence_of_url("v"), "http://creativecommons.org/publicdomain/mark/1.0/") == "public domain" and one(filters.licence_of_url("v"), "https://x.test") is None
    assert one(filters.free_licence("v"), "CC BY-SA 4.0") == "CC-BY-SA-4.0" and one(filters.free_licence("v"), "by-nc-4.0") is None
    assert one(filters.season_title("v"), "Season Two: Chapter IV of Ash") == "2 4 of ash"
    assert one(filters.series_of_episode("v"), "The Tin Lantern - Episode 12: Ash") == "The Tin Lantern" and one(filters.series_of_episode("v"), "Ash: 3") == "Ash"
    assert one(filters.family_sort_name("v", F.lit("van der Berg")), "Ana van der Berg") == "van der Berg, Ana" and one(filters.family_sort_name("v", F.lit("X")), "Ana Vale") == "Vale, Ana"
    assert tuple(one(filters.read_character("v"), "Self, Opal")) == ("player", "Opal") and tuple(one(filters.read_character("v"), "The Keeper")) == ("GM/DM", None)
    assert one(filters.hosts_in_prose("v"), "Hosted by Scott Moor, cuppycup and the rich sound of X. More") == ["Scott Moor", "cuppycup"]
    assert one(filters.entity_kind(F.array("v")), "Player characters of X") == "character" and one(filters.is_campaign("v"), "Season 2 trailer") is False
    assert one(text.wiki_page("v")["page"], "https://a.fandom.com/wiki/Ana_Vale?x=1") == "Ana_Vale"
    assert one(F.array_join(text.candidate_hosts("v", ["fandom.com"]), " "), "The Tin Lantern Podcast") == "tin-lantern.fandom.com tinlantern.fandom.com tin-lantern-podcast.fandom.com"


def test_near_titles_equal_brute_force(spark):
    r = random.Random(4)
    words = ["ash", "tin", "lantern", "of", "greywater", "a", "bell"]
    make = lambda n: [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 4)))) for i in range(n)] + [(n, ""), (n + 1, None), (n + 2, "greywter"), (n + 3, "x")]
    left, right = make(40), make(40)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    expected = {(i, j) for i, a in left for j, b in right if a and b and (a in b or b in a or edits(a, b) <= 2)}
    got = linking.near_titles(spark.createDataFrame(left, "l int, key string"), "l", spark.createDataFrame(right, "r int, key string"), "r").collect()
    assert {tuple(x) for x in got} == expected and len(got) == len(expected)



def test_parts_of_titles_are_never_broadcast(spark):
    left = spark.range(20).selectExpr("id AS l", "concat('the copper bells of greywater ', id) AS key")
    right = spark.range(20).selectExpr("concat('s', id) AS r", "CASE WHEN id < 10 THEN 'copper bells' ELSE concat('the copper bell of greywater ', id) END AS key")
    met = linking.near_titles(left, "l", right, "r")
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    least: dict = {}
    for x in met.collect():
        least[x["l"]] = min(x["r"], least.get(x["l"], x["r"]))
    first = linking.first_near(left, "l", right, "r")
    assert "BroadcastHashJoin" not in first._jdf.queryExecution().executedPlan().toString()
    assert {tuple(x) for x in first.collect()} == set(least.items()) == {(i, "s0") for i in range(20)}


def test_playlists_are_assigned_to_seasons(spark):
    seasons = [("s", "Tin Lantern", 1, "Fantasy High", 17, None), ("s", "Tin Lantern", 2, "Fantasy High: Part Two", 20, None), ("s", "Tin Lantern", 3, "Ash", None, None), ("s", "Tin Lantern", 4, "Unsleeping", 10, "p9"), ("s", "Tin Lantern", 5, "Ember", 5, None), ("s", "Tin Lantern", 6, None, 5, None), ("t", "Bells", 1, "Copper", 4, None), ("t", "Bells", 2, "Copper", 4, None)]
    playlists = [("s", "p1", "Tin Lantern: Fantasy High", 18), ("s", "p2", "Fantasy High Extra Credit", 17), ("s", "p3", "Ash and more", 43), ("s", "p9", "Unsleeping", 10), ("s", "p4", "Ember", 90), ("t", "q1", "Copper", 4)]
    games = spark.createDataFrame([("Ember",)], "name string")
    found = linking.season_playlists(spark.createDataFrame(seasons, "show string, show_title string, ordinal int, title string, episode_count int, taken string"), spark.createDataFrame(playlists, "show string, playlist string, title string, n int"), games)
    rows = {(r["show"], r["ordinal"]): r["playlist"] for r in found.collect()}
    assert rows == {("s", 1): "p1", ("t", 1): "q1"}
    shows = spark.createDataFrame([show(1, "s", ordinals=[1, 2]), show(2, "t"), show(3, "u", ordinals=[1])], SHOWS)
    done = {r["id"]: r["seasons"] for r in linking.with_playlists(shows, found, "https://video.test/list=").collect()}
    assert done["s"][0]["links"]["website"] == "https://video.test/list=p1" and done["s"][1]["links"] is None and done["u"][0]["links"] is None


def test_people_are_merged_greedily(spark):
    alias = lambda i, n: {f: None for f in model.ALIAS.names} | {"id": i, "name": n}
    source = lambda u: {f: None for f in model.SOURCE.names} | {"url": u, "tier": "reference"}
    people = [
        person(1, "a", canonical_name="Rob Vale", credits=[credit("s", 1, "x", role="player", sources=[source("u1")])], aliases=[alias("x", "Robbo")]),
        person(2, "b", canonical_name="Robert Vale", credits=[credit("s", 1, role="player", sources=[source("u2")]), credit("t", 1, role="host", sources=[source("u3")])]),
        person(3, "c", canonical_name="Robe Vale", credits=None), person(4, "d", canonical_name="Ana Moor"),
    ]
    df = spark.createDataFrame(people, PEOPLE)
    chosen = merge.choices(df, integrity.same_person_pairs(df))
    assert {(r["root"], r["loser"]) for r in chosen.collect()} == {("b", "a"), ("b", "c")}
    merged = {r["id"]: r for r in merge.merge_people(df, chosen).collect()}
    assert set(merged) == {"b"} and {a["name"] for a in merged["b"]["aliases"]} == {"Robbo", "Rob Vale", "Robe Vale"}
    assert [(c["show"], {s["url"] for s in c["sources"]}) for c in merged["b"]["credits"]] == [("s", {"u1", "u2"}), ("t", {"u3"})]


def test_the_gate_refuses(spark, tmp_path):
    for name in model.COLLECTIONS:
        (tmp_path / name).mkdir()
    (tmp_path / "games" / "g.yml").write_text("id: g\nname: Game\nedition: '1'\npublisher: P\n")
    assert files.gated(spark, str(tmp_path))["games"].count() == 1
    (tmp_path / "games" / "h.yml").write_text("id: other\nname: Game\n")
    with pytest.raises(ValueError, match="games/h.yml"):
        files.gated(spark, str(tmp_path))
    bad = spark.createDataFrame([person(1, "Bad Id", canonical_name="A")], PEOPLE)
    with pytest.raises(ValueError, match="people:1"):
        integrity.checked(bad, spark.createDataFrame([], SHOWS))
    registry = spark.createDataFrame([("a", "cleared"), ("b", "refused")], "source string, clearance string")
    files.assert_cleared("a", registry)
    with pytest.raises(PermissionError):
        files.assert_cleared("b", registry)
    assert files.cleared_only(spark.createDataFrame([("a",), ("b",), (None,)], "s string"), "s", registry).count() == 1


def test_payload_sources(spark):
    pages = spark.createDataFrame([("p", 2, 0, "v3"), ("p", 1, 0, "v1"), ("p", 1, 1, "v2"), ("q", 1, 0, None)], "playlist string, page int, pos int, video string")
    assert [(r["place"], r["video"]) for r in files.playlist_videos(pages, 2).orderBy("place").collect()] == [(1, "v1"), (2, "v2")]
    entity = {"id": "Q1", "labels": {"en": {"value": "Ana Vale"}}, "aliases": {"en": [{"value": "Ana V."}, {"value": "Ana Vale"}]}, "claims": {"P1559": [{"mainsnak": {"datavalue": {"value": {"text": "Ana Välé"}}}}], "P742": [{"mainsnak": {"datavalue": {"value": "Opal"}}}]}}
    names = files.entity_names(spark.createDataFrame([(json.dumps(entity),), ('{"id": "Q2"}',), (None,)], "json string")).collect()
    assert {(r["id"], r["name"], r["kind"]) for r in names} == {("Q1", "Ana Vale", "label"), ("Q1", "Ana V.", "alias"), ("Q1", "Ana Välé", "native"), ("Q1", "Opal", "stage")}
    images = spark.createDataFrame([("a", "Ana Vale", "Vale at a table", "u1", "CC BY 4.0"), ("a", "Ana Vale", "A valley", "u2", "CC BY 4.0"), ("b", "Bo", "Bo", "u3", "all rights")], "id string, name string, title string, url string, licence string")
    assert [tuple(r) for r in files.free_images(images).collect()] == [("a", "u1", "CC-BY-4.0")]
    archive = files.archive_items(spark.createDataFrame([('{"identifier": "i", "title": ["T", "U"], "subject": "A; B", "creator": "C"}',), ('{"subject": ["X"]}',)], "json string")).collect()
    assert (archive[0]["title"], archive[0]["subjects"], archive[1]["subjects"]) == ("T", ["a", "b"], ["x"])


def test_discovery(spark):
    items = [("Kit", "Tin Lantern Episode 1", "2020", None), ("KIT", "tin lantern Episode 2", "2021", "l"), ("Kit", "Tin Lantern part 3", "2019", None), ("Al", "A 1", None, None), ("Al", "B 2", None, None), ("Al", "C", None, None), ("Zo", "x", None, None)]
    found = discovery.archive_series(spark.createDataFrame(items, "creator string, title string, date string, licence string")).collect()
    assert {(r["creator"], r["title"].lower(), r["n_items"], r["earliest"]) for r in found} == {("KIT", "tin lantern", 3, "2019"), ("Al", "al", 3, None)}
    people = spark.createDataFrame([("a", None, "u"), ("b", "kept", None)], "id string, bio string, url string")
    outside = spark.createDataFrame([("a", "told", "v"), ("b", "other", "w")], "id string, bio string, url string")
    assert {tuple(r) for r in discovery.enriched(people, outside, ["bio", "url"]).collect()} == {("a", "told", "u"), ("b", "kept", "w")}
    assert spark.createDataFrame([("The Tin Lantern", "tinlantern")], "a string, b string").select(discovery.same_channel(F.col("a"), F.col("b")).alias("x")).first()["x"]


def test_episodes_count_for_their_series(spark):
    principals = spark.createDataFrame([("s", "n1"), ("e1", "n2"), ("e2", "n3"), ("e1", "n1")], "tconst string, nconst string")
    episodes = spark.createDataFrame([("e1", "s"), ("e1", "s"), ("e2", "other")], "tconst string, parentTconst string")
    rows = catalogue.with_episodes(principals, episodes, spark.createDataFrame([("show", "s")], "show string, tconst string")).collect()
    assert sorted((r["tconst"], r["nconst"]) for r in rows) == [("s", "n1"), ("s", "n1"), ("s", "n2")]


def test_import_adds_evidence_only(spark):
    source = {f: None for f in model.SOURCE.names} | {"url": "u1", "tier": "official"}
    people = spark.createDataFrame([person(1, "ana", canonical_name="Ana Vale", credits=[credit("s", 1, role="player", sources=[source])])], PEOPLE)
    rows = spark.createDataFrame([("ana", False, "Ana Vale", "s", 1, "player", "Opal", True, 1, "t1"), ("bo-reed", True, "Bo Reed", "s", 1, "player", None, False, 1, "t1")], "id string, is_new boolean, name string, show string, season int, role string, character string, confirmed boolean, n_seasons int, tconst string")
    done = {r["id"]: r["credits"] for r in catalogue.import_credits(people, rows).collect()}
    assert len(done["ana"]) == 1 and {s["url"] for s in done["ana"][0]["sources"]} == {"u1", "https://catalogue.test/title/t1"} and done["ana"][0]["character"] == "Opal"
    assert done["bo-reed"][0]["note"] == "Matched by title alone." and [tuple(r) for r in catalogue.created(rows).collect()] == [("bo-reed", "Bo Reed")]


@pytest.mark.parametrize("n", [0, 1, 5, 10, 200])
def test_daily_picks_are_the_first_of_the_whole_shuffle(spark, n):
    ids = [f"k{i:04}" for i in range(n)]
    got = ranking.daily_picks(spark.createDataFrame([(i,) for i in ids * 2], "id string"), "id", 20260101, 6).collect()
    assert {(r["id"], r["place"]) for r in got} == {(ids[k], p) for p, k in enumerate(ranking.shuffled(n, 20260101)[:6], 1)}


def test_a_page_is_found_by_any_name(spark):
    alias = {f: None for f in model.ALIAS.names} | {"id": "x", "name": "Opal Moor"}
    people = spark.createDataFrame([person(1, "ana-vale", canonical_name="Ana Välé", aliases=[alias]), person(2, "opal-moor", canonical_name="Zed"), person(3, "bo", canonical_name="Opal Moor")], PEOPLE)
    ask = lambda q: [r["id"] for r in publish.resolve_person(people, q).collect()]
    assert (ask("Ana Vale"), ask("opal moor"), ask("ANA VÄLÉ"), ask("nobody"), ask("")) == (["ana-vale"], ["opal-moor"], ["ana-vale"], [], [])


def test_links_are_described_in_order(spark):
    urls = ["https://x.test", "https://www.youtube.com/watch?v=1", "nonsense", "https://en.wikipedia.org/wiki/A", "https://x.test", None, "https://open.spotify.com/show/1"]
    row = spark.createDataFrame([(urls,)], "u array<string>").select(publish.described(F.col("u")).alias("l")).first()["l"]
    assert [(x["kind"], x["url"]) for x in row] == [("watch", urls[1]), ("listen", urls[6]), ("home", urls[0]), ("read", urls[3])]


def test_entities_are_written_apart(spark, tmp_path):
    publish.write_entities(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("_key=*")} == {"_key=a", "_key=b"}


def test_pages_follow_redirects(spark):
    pages = spark.createDataFrame([("h", "Ana Vale", "text"), ("h", "Ana", "#REDIRECT [[ana_Vale#x]]"), ("h", "A", "#redirect [[Ana]]"), ("h", "Loop", "#REDIRECT [[Loop]]"), ("h", "Lost", "#REDIRECT [[Gone]]"), ("i", "Ana Vale", "other")], "host string, title string, wikitext string")
    asked = spark.createDataFrame([("h", "Ana_Vale"), ("h", "ana"), ("h", "A"), ("h", "Loop"), ("h", "Lost"), ("h", "None")], "host string, page string")
    got = {(r["page"], r["title"], r["wikitext"]) for r in discovery.resolved_pages(asked, pages).collect()}
    assert got == {("Ana_Vale", "Ana Vale", "text"), ("ana", "Ana Vale", "text"), ("A", "Ana Vale", "text")}


def test_channels_wikis_and_feeds(spark):
    channels = spark.createDataFrame([("c", 500), ("d", 5), ("c", 10)], "channel string, subscribers int")
    playlists = spark.createDataFrame([("c", f"p{i}", i) for i in range(9)] + [("d", "q", 99)], "channel string, playlist string, n int")
    assert {r["playlist"] for r in discovery.promising_channels(channels, playlists, 100).collect()} == {f"p{i}" for i in range(3, 9)}
    wikis = spark.createDataFrame([("a", 20, "t"), ("b", 19, "t"), ("c", 50, None)], "host string, articles int, template string")
    assert [r["host"] for r in discovery.usable_wikis(wikis).collect()] == ["a"]
    shows = spark.createDataFrame([("a", "old", "kept"), ("b", "old", None)], "id string, title string, link string")
    feed = spark.createDataFrame([("a", "new", None)], "id string, title string, link string")
    assert {tuple(r) for r in discovery.overlaid(shows, feed, ["title", "link"]).collect()} == {("a", "new", "kept"), ("b", "old", None)}
    people = spark.createDataFrame([("ana-vale", "Q1"), ("bo", None)], "id string, wikidata_qid string")
    incoming = spark.createDataFrame([(1, "Q1", "Bo"), (2, "Q9", "Bo"), (3, None, "Zed"), (4, None, None)], "key int, qid string, name string")
    assert {tuple(r) for r in discovery.matched_entities(incoming, people).collect()} == {(1, "ana-vale", "identifier"), (2, "bo", "name"), (3, None, None), (4, None, None)}


@pytest.mark.parametrize(
    "value, kinds, people, dropped",
    [
        ("{{Starring| [[Ana Vale]] | [[Opal]] |--------| [[Bo Reed]] | DM }}", {}, [("Ana Vale", "Opal", False), ("Bo Reed", None, True)], []),
        ("{{Starring| [[Ana Vale]] | | [[Bo Reed]] | | Cy Dune | }}", {}, [("Ana Vale", None, False), ("Bo Reed", None, False), ("Cy Dune", None, False)], []),
        ("* [[Ana Vale]]\n* [[Bo Reed]] as [[Zed]] and [[Zod]]", {}, [("Ana Vale", None, False), ("Bo Reed", "Zed / Zod", False)], []),
        ("'''[[w:c:x:Ana|Ana Vale]]''' as [[Opal]]<br>[[Bo Reed]] – [[Zed]]", {}, [("Ana Vale", "Opal", False), ("Bo Reed", "Zed", False)], []),
        ("[[Ana Vale]] [[Opal]] [[Bo Reed]] [[Acme]] (DM)", {"Bo Reed": "person", "Acme": "organisation"}, [("Ana Vale", "Opal", False), ("Bo Reed", None, False)], ["Acme"]),
        ("[[Ana Vale]] (DM), [[Bo Reed]]", {"Ana Vale": "person", "Bo Reed": "person"}, [("Ana Vale", None, True), ("Bo Reed", None, False)], []),
        ("", {}, [], []),
    ],
)
def test_linked_values(value, kinds, people, dropped):
    cast = layouts.linked_cast(value, kinds)
    assert (cast.people, cast.dropped) == (people, dropped)


def test_pages_with_and_without_an_infobox():
    page = "{{Infobox campaign\n|players=* [[Ana Vale]] as [[Opal]]\n* [[Bo Reed]]\n|network=[[Acme]]\n|host=Cy Dune}}\nThe campaign is DMed by [[Dee Finch]]."
    assert layouts.cast_of_infobox(page) == ([("Ana Vale", "player", "Opal"), ("Bo Reed", "player", None), ("Cy Dune", "host", None), ("Dee Finch", "GM/DM", None)], [], ["network"])
    assert layouts.cast_of_infobox("== Cast ==\n* [[Ana Vale]] as the Keeper\n* [[Bo]] as Zed")[0] == [("Ana Vale", "GM/DM", None), ("Bo", "player", "Zed")]
    assert layouts.cast_of_infobox("") == ([], [], [])
