"""Sources: folders of YAML records with every problem reported, gzipped TSV dumps, feeds, JSON snapshots, and a licence gate."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from castgraph import model
from castgraph.functions import filters, text

try:
    import yaml
except ImportError:  # reading YAML then reports each file as a problem
    yaml = None


def core_loader():
    """A loader for the core schema of YAML 1.2: dates and yes/no stay strings."""
    loader = type("CoreLoader", (yaml.SafeLoader,), {})
    loader.yaml_implicit_resolvers = {}
    for tag, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^[-+]?[0-9]+$", list("-+0123456789")),
        ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$", list("-+.0123456789")),
    ):
        loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)
    return loader


def _problems_of(value, kind, path: str) -> Iterator[tuple[str, str]]:
    if value is None:
        return
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            yield path, "expected a mapping"
            return
        for key in value:
            if key not in kind.names:
                yield f"{path}.{key}".strip("."), "unknown key"
        for field in kind.fields:
            yield from _problems_of(value.get(field.name), field.dataType, f"{path}.{field.name}".strip("."))
    elif isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            yield path, "expected a list"
            return
        for i, item in enumerate(value):
            yield from _problems_of(item, kind.elementType, f"{path}.{i}")
    else:
        fits = {"string": str, "integer": int, "boolean": bool}[kind.typeName()]
        if not isinstance(value, fits) or (fits is int and isinstance(value, bool)):
            yield path, f"expected {kind.typeName()}"


def _shaped(value, kind):
    if value is None or isinstance(kind, T.StructType) and not isinstance(value, dict):
        return None
    if isinstance(kind, T.StructType):
        out = {f.name: _shaped(value.get(f.name), f.dataType) for f in kind.fields}
        if "game" in out and isinstance(value.get("game"), str):
            out["game"] = [value["game"]]
        return out
    if isinstance(kind, T.ArrayType):
        return [_shaped(v, kind.elementType) for v in value] if isinstance(value, list) else None
    return value


def _listed(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(name, size) of the YAML files of a folder, which may be missing. Spark itself passes over empty files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getLen()) for s in system.listStatus(path)] if system.exists(path) else []
    return sorted((n, size) for n, size in found if n.endswith((".yml", ".yaml")) and not n.startswith("."))


def read_collection(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(records, problems) of a folder of YAML files, one record each. No file stops another: a bad one is a problem (file, path, message).

    Hidden files are passed over. A record's `id` must be its file's name; unknown keys, wrong types, empty files and files that
    are no mapping are problems.
    """
    kind = model.COLLECTIONS[name]
    listed = _listed(spark, f"{folder}/{name}")
    empty = spark.createDataFrame([(f, "", "empty file") for f, size in listed if not size], "file string, path string, message string")
    if not any(size for _, size in listed):
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), *kind.fields])), empty
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yml,yaml}").load(f"{folder}/{name}")
    raw = found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("value")).where("NOT startswith(file, '.')")
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("record", kind), T.StructField("problems", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("message", T.StringType())])))])

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, value in zip(part["file"], part["value"]):
                problems, record = [], None
                try:
                    data = yaml.load(bytes(value).decode(), Loader=core_loader())  # a safe loader
                    if not isinstance(data, dict):
                        problems.append(("", "empty file" if data is None else "expected a mapping"))
                    else:
                        seasons = [s for s in data.get("seasons") or [] if isinstance(s, dict)] if isinstance(data.get("seasons"), list) else []
                        for season in seasons:
                            if isinstance(season.get("game"), str):
                                season["game"] = [season["game"]]
                        problems += _problems_of(data, kind, "")
                        if data.get("id") != file.rsplit(".", 1)[0]:
                            problems.append(("id", "differs from the file's name"))
                        record = _shaped(data, kind) if not problems else None
                except Exception as error:
                    problems.append(("", f"cannot be parsed: {type(error).__name__}"))
                rows.append((file, record, [{"path": p, "message": m} for p, m in problems]))
            yield pd.DataFrame(rows, columns=["file", "record", "problems"])

    parsed = raw.mapInPandas(parse, schema)
    problems = parsed.select("file", F.explode("problems").alias("p")).select("file", "p.path", "p.message")
    return parsed.where("record IS NOT NULL").select("file", "record.*"), problems.unionByName(empty)


def read_dump(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A TSV dump (gzip or not) with a header; \\N and empty cells are null, stray quotes are text. A gzip can't be split, so its rows are spread."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.csv(path, sep="\t", header=True, quote="", nullValue="\\N", schema=schema)
    rows = rows.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in columns])
    return rows.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else rows


def feed_items(feeds: DataFrame, xml: str = "xml", keep: list[str] | None = None) -> DataFrame:
    """(title, notes, link) of each item of RSS texts; encoded content is preferred to the description. `keep` has further tags."""
    items = feeds.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("item"))

    def tag(name: str):
        found = F.regexp_extract("item", rf"(?s)<{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)
        return F.nullif(found, F.lit(""))

    return items.select(tag("title").alias("title"), text.html_lines(F.coalesce(tag("content:encoded"), tag("description"))).alias("notes"), tag("link").alias("link"), *[tag(k).alias(k) for k in keep or []])


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def archive_items(items: DataFrame, raw: str = "json") -> DataFrame:
    """Items of an archive search, fields of which may be one value or several: the first counts, subjects are lower case."""
    def first(name: str):
        value = F.get_json_object(raw, f"$.{name}")
        listed = F.from_json(value, "array<string>")
        return F.when(F.startswith(value, F.lit("[")), F.get(listed, F.lit(0))).otherwise(value).alias(name)

    subject = F.get_json_object(raw, "$.subject")
    subjects = F.when(F.startswith(subject, F.lit("[")), F.from_json(subject, "array<string>")).otherwise(F.split(subject, r"\s*;\s*"))
    return items.select(first("identifier"), first("title"), first("creator"), first("description"), F.transform(subjects, F.lower).alias("subjects"), first("date"), first("licenseurl"))


def cleared_only(rows: DataFrame, source: str, registry: DataFrame) -> DataFrame:
    """Rows of sources whose clearance in the registry (source, clearance) is `cleared`."""
    cleared = registry.where("clearance = 'cleared'").select(F.col("source").alias("_source")).distinct()
    return rows.join(cleared, F.col(source) == F.col("_source"), "left_semi")


def read_all(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """All four collections of a folder and their problems together (collection, file, path, message)."""
    read = {name: read_collection(spark, folder, name) for name in model.COLLECTIONS}
    problems = None
    for name, (_, found) in read.items():
        told = found.select(F.lit(name).alias("collection"), "file", "path", "message")
        problems = told if problems is None else problems.unionByName(told)
    return {name: records for name, (records, _) in read.items()}, problems


def gated(spark: SparkSession, folder: str, show_most: int = 20) -> dict[str, DataFrame]:
    """The collections of a folder, or an error that names the first problems by file."""
    records, problems = read_all(spark, folder)
    first = problems.orderBy("collection", "file", "path", "message").limit(show_most).collect()
    if first:
        raise ValueError("refused: " + "; ".join(f"{p['collection']}/{p['file']} {p['path']}: {p['message']}" for p in first))
    return records


def assert_cleared(source: str, registry: DataFrame) -> None:
    """Refuse a source that the registry (source, clearance) doesn't list as cleared."""
    if registry.where((F.col("source") == source) & (F.col("clearance") == "cleared")).isEmpty():
        raise PermissionError(f"{source} is not cleared for use")


def playlist_videos(pages: DataFrame, most: int) -> DataFrame:
    """(playlist, place, video): the first videos of each playlist by page and position, at most so many; only these are shuffled."""
    place = F.row_number().over(Window.partitionBy("playlist").orderBy("page", "pos"))
    return pages.where("video IS NOT NULL").withColumn("place", place).where(F.col("place") <= most).select("playlist", "place", "video")


def entity_names(entities: DataFrame, raw: str = "json") -> DataFrame:
    """(id, name, kind): names of encyclopaedia entities, each once with the first of its kinds: label, alias, native name, pseudonym, birth name."""
    value = lambda path: F.get_json_object(raw, path)
    listed = lambda path: F.transform(F.from_json(value(path), "array<struct<value: string>>"), lambda a: a["value"])
    claimed = lambda p: F.transform(F.from_json(value(f"$.claims.{p}"), "array<struct<mainsnak: struct<datavalue: struct<value: string>>>>"), lambda c: F.coalesce(F.get_json_object(c["mainsnak"]["datavalue"]["value"], "$.text"), c["mainsnak"]["datavalue"]["value"]))
    kinds = [("label", F.array(value("$.labels.en.value"))), ("alias", listed("$.aliases.en")), ("native", claimed("P1559")), ("stage", claimed("P742")), ("birth", claimed("P1477"))]

    def ranked(rank: int, kind: str, names):
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))

    pairs = F.flatten(F.array(*[ranked(i, kind, names) for i, (kind, names) in enumerate(kinds)]))
    rows = entities.select(value("$.id").alias("id"), F.explode(pairs).alias("_n")).select("id", "_n.*").where("name IS NOT NULL")
    return rows.groupBy("id", "name").agg(F.min_by("kind", "rank").alias("kind"))


def free_images(found: DataFrame) -> DataFrame:
    """(id, url, licence): found images (id, name, title, url, licence) whose licence is known to be free and whose title has the name's last word."""
    last = F.element_at(F.split(text.normal_name("name"), " "), -1)
    fits = (last != "") & F.contains(F.concat(F.lit(" "), text.normal_name("title"), F.lit(" ")), F.concat(F.lit(" "), last, F.lit(" ")))
    return found.withColumn("licence", filters.free_licence("licence")).where(fits & F.col("licence").isNotNull()).select("id", "url", "licence")
