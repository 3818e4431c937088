"""Typed and provenance-keeping scans: CSV, JSON lines, folders of JSON, layered tranches, GeoJSON, HTML tables and metadata."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header as strings, nothing inferred; quotes are doubled within quotes."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).csv(path)


def csv_typed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV with a header by an explicit schema; a cell that does not fit its type fails the read instead of turning null."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def json_lines(spark: SparkSession, path: str, schema: str | StructType, status: str | None = None, allowed: list[str] | None = None) -> DataFrame:
    """JSON lines by an explicit schema, kept where the status column has an allowed value."""
    rows = spark.read.schema(schema).json(path)
    return rows.where(F.col(status).isin(allowed)) if status else rows


def json_folder(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON document per file, whatever its line breaks, with the file it came from."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def latest_tranche(rows: DataFrame, key: list[str], tranche: str, superseded: list[str], layer: str) -> DataFrame:
    """Each key's row of the newest tranche; layers named in ``superseded`` are skipped. Of several in one tranche the greatest by all its
    columns is taken (maps, which have no order, aside), whatever the order of rows. A maximum per key, so nothing is sorted."""
    live = rows.where(~F.coalesce(F.col(layer).isin(superseded), F.lit(False))) if superseded else rows
    ordered = [F.col(f"`{f.name}`") for f in live.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    newest = live.groupBy(*key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in live.columns]), F.struct(F.col(tranche), *ordered)).alias("r"))
    return newest.select("r.*")


GEO = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"


def geo_features(texts: DataFrame, text: str, name: str) -> DataFrame:
    """(name, parts, points, min_x, min_y, max_x, max_y): features of GeoJSON texts, their parts merged by name.

    Coordinates are read as text and taken apart by number pairs, so polygons and multipolygons need one path.
    """
    f = texts.select(F.explode(F.from_json(text, GEO)["features"]).alias("f"))
    pair = r"\[\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*,\s*(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*\]"
    c = F.col("f.geometry.coordinates")
    f = f.select(F.col("f.properties")[name].alias("name"), F.regexp_extract_all(c, F.lit(pair), F.lit(1)).cast("array<double>").alias("x"), F.regexp_extract_all(c, F.lit(pair), F.lit(2)).cast("array<double>").alias("y"))
    return f.groupBy("name").agg(
        F.count("*").alias("parts"), F.sum(F.size("x")).cast("long").alias("points"), F.min(F.array_min("x")).alias("min_x"), F.min(F.array_min("y")).alias("min_y"),
        F.max(F.array_max("x")).alias("max_x"), F.max(F.array_max("y")).alias("max_y"),
    )


def pick_representation(candidates: DataFrame, id_: str) -> DataFrame:
    """(id, chosen, text, alternatives): the usable candidate (id, kind, rank, text) of the least rank, and the other usable kinds."""
    usable = candidates.where(F.length(F.trim("text")) > 0)
    best = usable.groupBy(id_).agg(F.min_by(F.struct("kind", "text"), F.struct("rank", "kind")).alias("b"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    return best.select(id_, F.col("b.kind").alias("chosen"), F.col("b.text").alias("text"), F.filter("kinds", lambda k: k != F.col("b.kind")).alias("alternatives"))


def inventory(spark: SparkSession, dimensions: dict[str, list[str]], ranges: list[tuple[str, str]]) -> DataFrame:
    """Every combination of the dimensions' values with every date range (from, to), each with an id that is the hash of its
    content. The dimensions are configuration, so the product is exploded from one row."""
    out = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("since"), F.lit(b).alias("until")) for a, b in ranges])).alias("r")).select("r.*")
    for name, values in dimensions.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    names = [*dimensions, "since", "until"]
    return out.select(F.substring(F.sha2(F.concat_ws("|", *names), 256), 1, 16).alias("query_id"), *names)


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; ``load`` refuses keys that it does not know."""

    start: str = "1992-01-01"
    end: str = "1998-12-31"
    minimum: int = 3
    arms: tuple[str, ...] = ("local", "national")

    @classmethod
    def load(cls, given: dict) -> RunConfig:
        unknown = sorted(set(given) - {f.name for f in fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        out = cls(**{**given, **({"arms": tuple(given["arms"])} if "arms" in given else {})})
        if out.start > out.end:
            raise ValueError("start is after end")
        return out
