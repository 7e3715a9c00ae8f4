import gzip
import json
import random
import re
import unicodedata
from datetime import datetime

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castgraph import model
from castgraph.functions import text
from castgraph.operators import extraction, flatten, integrity, merge, orphans, ranking, relations
from castgraph.plans import registry
from castgraph.sources import files

PEOPLE = T.StructType([T.StructField("rec_no", T.LongType()), *model.PERSON.fields, T.StructField("loaded_at", T.TimestampNTZType()), T.StructField("extra", T.StringType())])
SHOWS = T.StructType([T.StructField("rec_no", T.LongType()), *model.SHOW.fields, T.StructField("loaded_at", T.TimestampNTZType()), T.StructField("removed_at", T.TimestampNTZType())])


def credit(show=None, season=None, alias=None, **other):
    return {f: None for f in model.CREDIT.names} | {"show": show, "season": season, "alias": alias} | other


def person(rec_no, id=None, at=None, **other):
    return {f: None for f in PEOPLE.names} | {"rec_no": rec_no, "id": id, "loaded_at": at} | other


def show(rec_no, id=None, at=None, removed=None, ordinals=(), games=()):
    seasons = [{f: None for f in model.SEASON.names} | {"ordinal": o, "game": list(games)} for o in ordinals]
    return {f: None for f in SHOWS.names} | {"rec_no": rec_no, "id": id, "loaded_at": at, "removed_at": removed, "seasons": seasons}


def day(n):
    return datetime(2024, 1, n)


@pytest.fixture(scope="module")
def tables(spark):
    alias = {f: None for f in model.ALIAS.names} | {"id": "a"}
    people = [
        person(1, "p", day(5), aliases=[None, alias], credits=[None, credit("ok", 1, "a"), credit("ok", 9, "b"), credit("gone", 1), credit("late"), credit("no", 3), credit()]),
        person(2, "p", None, credits=[credit("gone"), credit("late")]),
        person(3, None, day(5), credits=[]),
        person(4, "q", day(5), credits=None),
    ]
    shows = [show(1, "ok", day(1), ordinals=[1], games=["g", None, "x", "x"]), show(2, "gone", day(1), day(5), [1]), show(3, "late", day(9)), show(4, "late", day(8)), show(5, None, day(1))]
    games = spark.createDataFrame([("g",), (None,)], "id string")
    return spark.createDataFrame(people, PEOPLE), spark.createDataFrame(shows, SHOWS), games


def test_orphans(tables):
    found = {tuple(r)[:6] for r in orphans.orphan_references(*tables).collect()}
    assert found == {
        ("people", 1, 2, "season", "9", "missing"), ("people", 1, 2, "alias", "b", "missing"), ("people", 1, 3, "show", "gone", "removed"), ("people", 1, 4, "show", "late", "late"),
        ("people", 1, 5, "show", "no", "missing"), ("shows", 1, 0, "game", "x", "missing"),
    }
    counts = {(r["src"], r["field"], r["status"], r["period"], r["n_refs"], r["n_keys"]) for r in orphans.orphan_counts(*tables).collect()}
    assert counts == {(*k, "2024-01", 1, 1) for k in [("people", "season", "missing"), ("people", "alias", "missing"), ("people", "show", "removed"), ("people", "show", "late"), ("people", "show", "missing"), ("shows", "game", "missing")]}


def test_counts_within_a_month_that_a_show_is_removed_in(spark):
    people = [person(i, f"p{i}", day(i), credits=[credit("s"), credit("t"), credit("s", 2)]) for i in range(1, 11)]
    shows = [show(1, "s", day(3), day(7), [1]), show(2, "t", day(20))]
    given = spark.createDataFrame(people, PEOPLE), spark.createDataFrame(shows, SHOWS), spark.createDataFrame([], "id string")
    counts = {(r["field"], r["status"]): (r["n_refs"], r["n_keys"]) for r in orphans.orphan_counts(*given).collect()}
    assert counts == {("show", "removed"): (8, 1), ("show", "late"): (14, 2), ("season", "missing"): (10, 1)}
    found = orphans.orphan_references(*given).groupBy("field", "status").agg(F.count("*").alias("n")).collect()
    assert {(r["field"], r["status"]): r["n"] for r in found} == {k: n for k, (n, _) in counts.items()}


def test_orphans_of_empty_tables(spark):
    empty = spark.createDataFrame([], PEOPLE), spark.createDataFrame([], SHOWS), spark.createDataFrame([], "id string")
    assert orphans.orphan_references(*empty).count() == 0 and orphans.orphan_counts(*empty).count() == 0


@pytest.mark.parametrize("share", [0.001, 0.1, 0.9])
def test_heavy_keys_give_the_same_orphans(spark, share):
    refs = [("hot", 1, 1000), ("cold", 1, 500), *[(f"k{i}", i % 3, i) for i in range(1, 30)], (None, 1, 9)]
    counts = spark.createDataFrame(refs, "k string, season int, n_refs long")
    targets = spark.createDataFrame([("hot",), ("k3",), ("k3",), (None,)], "t string")
    expected = {r for r in refs if r[0] not in ("hot", "k3", None)}
    assert {tuple(r) for r in orphans.anti_counts(counts, "k", targets, "t", share).select("k", "season", "n_refs").collect()} == expected


def _brute(records):
    out = set()
    for key, line in records:
        for i, c in enumerate(json.loads(line).get("credits") or []):
            if c is not None:
                out.add((key, "credit", i, -1, json.dumps(c)))
                for j, s in enumerate((c.get("sources") if isinstance(c, dict) else None) or []):
                    if s is not None:
                        out.add((key, "source", i, j, json.dumps(s)))
    return out


texts = st.text(alphabet=st.sampled_from('ab"\\{}[],: \n\té€😀'), max_size=8)
sources = st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({"url": texts, "sources": texts})), max_size=3))
records = st.lists(st.fixed_dictionaries({"aliases": st.lists(texts, max_size=2), "credits": st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({"show": texts, "sources": sources})), max_size=4))}), min_size=1, max_size=5)


@settings(max_examples=150, deadline=None)
@given(records, st.sampled_from([None, 1]))
def test_structural_index_reads_like_a_parser(items, indent):
    lines = [(i, json.dumps(r, ensure_ascii=False, indent=indent)) for i, r in enumerate(items)]
    found = set()
    for name, record, pos, sub, values in flatten._index_block(pa.array([k for k, _ in lines]), pa.array([x for _, x in lines]), [flatten.PEOPLE_CHILDREN[1], flatten.PEOPLE_CHILDREN[2]]):
        found |= {(int(r), name, int(p), int(s), json.dumps(json.loads(v))) for r, p, s, v in zip(record, pos, sub, values)}
    assert found == _brute(lines)


def test_broken_records_do_not_affect_others(spark):
    rows = [(1, '{"credits":[{"show":"a'), (2, '{"credits":[{"show":"b","sources":[null,{"url":"u"}]},null,{}]}'), (3, None), (4, ""), (5, "[]"), (6, '{"credits":null}')]
    found = flatten.flatten_json(spark.createDataFrame(rows, "rec_no long, j string"), "rec_no", "j", flatten.PEOPLE_CHILDREN).where("rec_no > 1").collect()
    assert {(r["rec_no"], r["child"], r["pos"], r["subpos"]) for r in found} == {(2, "credit", 0, -1), (2, "credit", 2, -1), (2, "source", 0, 1)}


SRC = {f: None for f in model.SOURCE.names}
A, B = SRC | {"url": "A"}, SRC | {"url": "B"}


@pytest.mark.parametrize(
    "existing, new, outcome, size",
    [
        ([], credit("s", 1, role="player", sources=[A]), "added", 1),
        ([credit("s", 1, role="player", sources=[A])], credit("s", 1, role="player", sources=[B]), "corroborated", 1),
        ([credit("s", 1, role="player", sources=[A])], credit("s", 1, role="guest player", sources=[A]), "already-cited", 1),
        ([credit("s", 1, role="player", character="Opal", sources=[A])], credit("s", 1, role="player", character="Opal Stone", sources=[B]), "corroborated", 1),
        ([credit("s", 1, role="player", character="Coru", sources=[A])], credit("s", 1, role="player", character="Arch Heart", sources=[B]), "added", 2),
        ([credit("s", 1, role="GM/DM", sources=[A])], credit("s", 1, role="player", sources=[B]), "corroborated", 1),
        ([credit("s", 1, role="GM/DM", sources=[A])], credit("s", 1, role="player", character="Zed", sources=[B]), "added", 2),
        ([credit("s", 1, role="GM/DM", sources=[A])], credit("s", 1, role="player", character="Self", sources=[B]), "corroborated", 1),
        ([credit("s", 1, role="producer", sources=[A])], credit("s", 1, role="player", sources=[B]), "corroborated", 1),
        ([credit("s", 1, role="player", sources=[A]), credit("s", 2, role="player", sources=[A])], credit("s", role="player", sources=[B]), "corroborated", 2),
        ([credit("s", 1, role="player", sources=[SRC | {"note": "n"}])], credit("s", 1, role="player", sources=[SRC | {"note": "n"}]), "corroborated", 1),
    ],
)
def test_upsert(existing, new, outcome, size):
    result, credits = merge.upsert(existing, new)
    assert (result, len(credits)) == (outcome, size)
    assert sum(len(c["sources"]) for c in credits) >= sum(len(c["sources"]) for c in existing)


def test_character_is_filled_but_not_overwritten():
    assert merge.upsert([credit("s", 1, role="player", sources=[A])], credit("s", 1, role="player", character="Opal", sources=[B]))[1][0]["character"] == "Opal"
    assert merge.upsert([credit("s", 1, role="player", character="Opal", sources=[A])], credit("s", 1, role="player", character="Opal Stone", sources=[B]))[1][0]["character"] == "Opal"


some_credit = st.builds(lambda s, n, r, c, u: credit(s, n, role=r, character=c, sources=[SRC | {"url": u}]), st.sampled_from("ab"), st.sampled_from([None, 1, 2]), st.sampled_from(["player", "GM/DM", "guest player", "editor"]), st.sampled_from([None, "Opal", "Zed / Ash", "Self"]), st.sampled_from("xyz"))


@settings(max_examples=200, deadline=None)
@given(st.lists(some_credit, max_size=7))
def test_fold_keeps_all_evidence_and_is_idempotent(items):
    folded = merge.deduplicated(items)
    assert len(folded) <= len(items)
    assert {s["url"] for c in folded for s in c["sources"]} == {s["url"] for c in items for s in c["sources"]}
    for item in items:
        outcome, again = merge.upsert(folded, item)
        assert merge.upsert(again, item)[0] == "already-cited"


def test_people_are_merged_without_losing_sources():
    base = {f: None for f in model.PERSON.names}
    one = base | {"id": "a", "canonical_name": "Al", "credits": [credit("s", 1, role="player", sources=[A])]}
    two = base | {"id": "b", "canonical_name": "Bo", "bio": "x", "credits": [credit("s", 1, "z", role="player", sources=[B]), credit("t", 1, "z", role="host", sources=[A])]}
    both = merge.merged_person(one, two)
    assert both["id"] == "a" and both["bio"] == "x" and [len(c["sources"]) for c in both["credits"]] == [2, 1] and both["credits"][1]["alias"] is None


def test_provenance(spark):
    rows = [(1, [credit("s", 1, sources=[SRC | {"tier": "community", "url": "https://www.W.test/x"}, SRC | {"tier": "official", "url": "https://t.test:8080/c"}, None]), credit("s", 2, sources=[SRC | {"tier": "firsthand", "attested_by": " V "}, SRC | {"tier": "firsthand", "attested_by": "v"}]), credit("s", sources=[])])]
    got = relations.with_provenance(spark.createDataFrame(rows, T.StructType([T.StructField("i", T.LongType()), T.StructField("c", T.ArrayType(model.CREDIT))])).select(F.explode("c").alias("c")).select("c.*")).collect()
    assert [(r["n_origins"], r["status"], r["best_tier"]) for r in got] == [(2, "corroborated", "official"), (1, "single-source", "firsthand"), (0, "single-source", None)]


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert one(text.normal_name(F.lit("  José  Núñez! "))) == "jose nunez"
    assert one(text.name_key(F.lit("Dr. Matt O'Brien Jr"))) == "matt obrien"
    assert one(text.title_key(F.lit("The Dungeons & Dragons"))) == "dungeons and dragons"
    assert one(text.slug(F.lit("Été: 2 | x"), drop_after_pipe=True)) == "ete-2"
    assert one(text.sort_name(F.lit("Ana Maria Silva"))) == "Silva, Ana Maria"
    assert one(text.url_host(F.lit("https://u@WWW.A.test:443/x"))) == "a.test"
    assert one(text.url_host(F.lit("no url"))) is None
    assert one(text.link_label(F.lit("https://www.youtube.com/playlist?list=P1"))["kind"]) == "watch"
    assert one(text.real_character(F.lit(" Self "))) is None
    assert one(text.year_range(F.lit("2019-05"), F.lit("2021"))) == "2019–2021"
    assert one(text.compact_count(F.lit(1_200_000))) == "1.2M" and one(text.compact_count(F.lit(12_345))) == "12K"
    assert one(text.html_lines(F.lit("<p>a&amp;b</p><script>x</script>c"))) == "a&b\nc"
    assert one(text.wikitext_plain(F.lit("'''A''' [[B|C]]<ref>x</ref>"))) == "A C"
    assert one(text.close(F.lit("lantern"), F.lit("lantren"))) is True and one(text.close(F.lit("a"), F.lit(""))) is False
    assert one(text.yaml_quoted(F.lit("yes"))) == '"yes"' and one(text.yaml_quoted(F.lit("plain"))) == "plain"


def test_close_pairs_equal_all_pairs(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    brute = df.toDF("a").crossJoin(df.toDF("b")).where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b") <= 2))
    assert {tuple(x) for x in ranking.close_pairs(df, "w", 2).collect()} == {tuple(x) for x in brute.collect()}


def test_seeded_draws():
    assert round(next(ranking.mulberry32(20260101)), 10) == 0.2559139896
    assert list(ranking.shuffled(10, 20260101)[:6]) == [6, 5, 3, 9, 1, 7]


def test_rules(spark):
    bad = person(1, "Bad_Slug", canonical_name="X", wikidata_qid="Q0", credits=[credit("s", role="guest player", episode="e", sources=[SRC | {"url": "https://a.test/x"}, SRC | {"url": "https://A.test/x/"}]), credit("s", -1, sources=[])])
    broken = {r["rule"] for r in integrity.violations(spark.createDataFrame([bad], PEOPLE), integrity.person_rules()).collect()}
    assert broken == {"slug", "qid", "canonical_among_aliases", "credit_sources", "episode_needs_season", "url_cited_twice", "credit_season_positive"}


def test_yaml_collection(spark, tmp_path):
    folder = tmp_path / "shows"
    folder.mkdir()
    (folder / "tin-lantern.yml").write_text("id: tin-lantern\ntitle: The Tin Lantern\nchannels: [c]\nseasons: [{ordinal: 1, game: ember, started: 2019-03-01}]\n")
    (folder / "empty.yml").write_text("")
    (folder / "other.yml").write_text("id: wrong\ncolour: red\nsolo: 'yes'\n")
    (folder / "broken.yml").write_text("a: [")
    good, problems = files.read_collection(spark, str(tmp_path), "shows")
    row = good.first()
    assert row["id"] == "tin-lantern" and row["seasons"][0]["started"] == "2019-03-01" and row["seasons"][0]["game"] == ["ember"]
    assert {(r["file"], r["path"]) for r in problems.collect()} == {("empty.yml", ""), ("other.yml", "id"), ("other.yml", "colour"), ("other.yml", "solo"), ("broken.yml", "")}
    good, problems = files.read_collection(spark, str(tmp_path), "games")
    assert good.count() == 0 and problems.count() == 0


def test_dump_and_feed(spark, tmp_path):
    with gzip.open(tmp_path / "d.tsv.gz", "wt") as f:
        f.write('t\tc\nx\t["A \\"B"]\ny\t\\N\nz"\t\n')
    assert {tuple(r) for r in files.read_dump(spark, str(tmp_path / "d.tsv.gz"), ["t", "c"]).collect()} == {("x", '["A \\"B"]'), ("y", None), ('z"', None)}
    xml = "<rss><item><title>T1</title><description>d</description><content:encoded><![CDATA[<p>n</p>]]></content:encoded><link>l</link></item><item><title>T2</title></item></rss>"
    assert [tuple(r) for r in files.feed_items(spark.createDataFrame([(xml,)], "xml string")).collect()] == [("T1", "n", "l"), ("T2", None, None)]


def test_extraction():
    page = "{{Infobox campaign|players=[[Ana Vale]] as Opal<br>Bo Reed (Zed)|game master={{small|x}}|starring=[[X|Cy Dune]]}}"
    assert extraction.credits_of_infobox(page) == [("Ana Vale", "player", "Opal"), ("Bo Reed", "player", "Zed"), ("x", "GM/DM", None), ("Cy Dune", "player", None)]
    assert extraction.credits_of_description("Hello\nCast:\nAna Vale as Opal\nBo Reed - Zed\n\nbye") == [("Ana Vale", "player", "Opal"), ("Bo Reed", "player", "Zed")]
    assert extraction.credits_of_description("GM: Cy Dune\nPlayers: Ana Vale, Bo Reed") == [("Cy Dune", "GM/DM", None), ("Ana Vale", "player", None), ("Bo Reed", "player", None)]
    assert extraction.credits_of_notes("Ana Vale as Opal\nguest Bo Reed plays Zed\n")[0] == ("Ana Vale", "player", "Opal")
    assert extraction.common_title(["The Tin Lantern Episode 1", "The Tin Lantern Episode 2"]) == "The Tin Lantern"


def test_queries_of_all_names_equal_brute_force(spark, tmp_path):
    def plain(name):
        return re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", name)).lower()

    spellings = ["Ana Vale", "Ana\u2003Vale", "Ána Vale\u200b", "Anastasia\u2003Vale", "Анна Vale", "Bo ﬁnch", "Милан Бервесон", "Zoë O\u2019Dell", "Zoe O'Dell", "\u212bsa Moe", "Åsa Moe", None]
    alias = lambda n: {f: None for f in model.ALIAS.names} | {"name": n}
    people = [person(i, f"p{i:02}", canonical_name=n, aliases=[alias(n)]) for i, n in enumerate(spellings)]
    spark.createDataFrame(people, PEOPLE).write.parquet(str(tmp_path / "people.parquet"))
    spark.createDataFrame([], SHOWS).write.parquet(str(tmp_path / "shows.parquet"))
    for other in ("channels", "games"):
        spark.createDataFrame([], "id string").write.parquet(str(tmp_path / f"{other}.parquet"))
    got = lambda name: {tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()}

    named = [(i, f"p{i:02}", plain(n)) for i, n in enumerate(spellings) if n]
    assert got("text_forms") == {(i, re.sub("[^a-z0-9]+", " ", n).strip(), re.sub("[^a-z0-9]+", "-", n).strip("-")) for i, _, n in named}
    by_key = {}
    for _, id, n in named:
        by_key.setdefault(re.sub("[^a-z0-9]+", " ", n).strip(), []).append(id)
    assert got("shared_names") == {(k, "|".join(ids), len(ids)) for k, ids in by_key.items() if k and len(ids) > 1}
    words = [(id, re.sub(r"\s+", " ", re.sub("[^a-z ]", "", n)).strip().split(" ")) for _, id, n in named]
    words = [(id, w[0], w[-1]) for id, w in words if len(w) >= 2]
    alike = lambda x, y: x == y or min(len(x), len(y)) >= 3 and (x.startswith(y) or y.startswith(x))
    assert got("same_person_pairs") == {(a, b) for a, f, m in words for b, g, n in words if a < b and m == n and alike(f, g)}


def test_cast_lists_are_read_to_their_ends():
    cast = [(f"{a} Vale{b}", "player", f"Part {a}{b}") for a in ("Ana", "Bo", "Cy", "Dee") for b in "abcdefghijklmnopqrst"]
    lines = [f"{name} as {part}" for name, _, part in cast]
    assert extraction.credits_of_description("\n".join(["Cast:", *lines])) == cast
    assert extraction.credits_of_description("\n\n".join(["Cast:", *lines])) == cast
    assert extraction.credits_of_description("\n".join(["Cast:", *lines[:3], "", "See you soon", "", "Players", *lines[3:], "", "Otto Marlow"])) == [*cast, ("Otto Marlow", "player", None)]
    assert len(extraction.credits_of_description("\n".join(["Cast:", *lines]), window=60)) == 60


@pytest.mark.parametrize("blanks", [1, 64, 65, 1000])
def test_any_number_of_blanks_in_json(spark, blanks):
    gap = " " * blanks
    text_ = f'{{"a":{gap}[{gap}1{gap},{gap}null{gap},{gap}{{"b":{gap}[{gap}2{gap}]{gap}}}{gap}]{gap}, "c": [{gap}]}}'
    df = spark.createDataFrame([(7, text_)], "k long, t string")
    found = {(r["child"], r["pos"], r["subpos"], "".join(r["value"].split())) for r in flatten.flatten_json(df, "k", "t", [flatten.Child("a", "a"), flatten.Child("b", "a", "b"), flatten.Child("c", "c")]).collect()}
    assert found == {("a", 0, -1, "1"), ("a", 2, -1, '{"b":[2]}'), ("b", 2, 0, "2")}
