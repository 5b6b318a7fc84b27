"""Component inventories: CycloneDX documents, lock files, checksum files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlake import schemas
from scanlake.functions.rows import each, each_entry, keep_where
from scanlake.functions.text import make_purl
from scanlake.sources.artifacts import parse_json


def read_sbom(df: DataFrame) -> DataFrame:
    """One row per component; a readable inventory without components keeps one row."""
    doc = keep_where(parse_json(df, schemas.SBOM), F.col("well_formed"))
    rows = doc.select(
        "scan_id", "file", "doc.bomFormat", "doc.specVersion", F.explode_outer("doc.components").alias("c")
    )
    return rows.select(
        "scan_id",
        "file",
        F.coalesce("bomFormat", F.lit("Unknown")).alias("format"),
        F.coalesce("specVersion", F.lit("Unknown")).alias("spec"),
        F.col("c").isNotNull().alias("has_component"),
        F.col("c.type").alias("type"),
        F.col("c.name").alias("name"),
        F.col("c.version").alias("version"),
        F.col("c.purl").alias("purl"),
    )


def sbom_component_count(df: DataFrame) -> DataFrame:
    """Components per file: 0 for a list that is absent or null, null for unreadable JSON."""
    doc = parse_json(df, schemas.SBOM_TYPES)
    n = F.coalesce(F.size("doc.components"), F.lit(0)).cast("bigint")
    return doc.select("scan_id", "file", F.when(F.col("well_formed"), n).alias("components"))


def _library(kind: str, name: Column, version: Column) -> list[Column]:
    return [
        F.lit("library").alias("type"),
        name.alias("name"),
        version.alias("version"),
        make_purl(kind, name, version).alias("purl"),
    ]


def lockfile_components(df: DataFrame) -> DataFrame:
    """npm lock: the packages map, or the dependencies map where there is none; the empty key is the project."""
    doc = df.withColumn("doc", F.from_json("content", schemas.NPM_LOCK, {"mode": "PERMISSIVE"}))
    rows = each_entry(doc, ["scan_id", "file"], F.coalesce("doc.packages", "doc.dependencies"))
    name = F.replace("k", F.lit("node_modules/"), F.lit(""))
    version = F.coalesce("v.version", F.lit("unknown"))
    return rows.where(F.col("k") != "").select("scan_id", "file", *_library("npm", name, version))


def manifest_components(df: DataFrame) -> DataFrame:
    """npm manifest, used without a lock: range marks at the start of a version are dropped."""
    doc = df.withColumn("doc", F.from_json("content", schemas.NPM_MANIFEST, {"mode": "PERMISSIVE"}))
    groups = F.concat(
        F.coalesce(F.map_entries("doc.dependencies"), F.array()),
        F.coalesce(F.map_entries("doc.devDependencies"), F.array()),
    )
    rows = each(doc, ["scan_id", "file"], groups, "e").select("scan_id", "file", F.col("e.key").alias("k"), F.col("e.value").alias("v"))
    version = F.regexp_replace("v", "^[\\^~>=<]+", "")
    return rows.select("scan_id", "file", *_library("npm", F.col("k"), version))


def gosum_components(df: DataFrame) -> DataFrame:
    """Checksum lines ``name version[/go.mod] hash``; each name@version once per file, settled inside the row."""
    words = F.transform(F.split("content", "\n"), lambda line: F.split(F.trim(line), r"\s+"))
    pairs = F.transform(
        F.filter(words, lambda w: F.size(w) >= 2),
        lambda w: F.concat(w[0], F.lit(" "), F.regexp_replace(F.substring_index(w[1], "/", 1), "^v+", "")),
    )
    rows = each(df, ["scan_id", "file"], F.array_distinct(pairs), "pair")
    name, version = F.substring_index("pair", " ", 1), F.substring_index("pair", " ", -1)
    return rows.select("scan_id", "file", *_library("golang", name, version))


def expand_image_catalog(repositories: DataFrame, tags: DataFrame, registry: str) -> DataFrame:
    """Catalogue documents x tag documents; repositories without tags are skipped."""
    repo = each(repositories, [], F.from_json("content", "repositories array<string>")["repositories"], "repo")
    tag = each(tags, ["repo"], F.from_json("content", "tags array<string>")["tags"], "tag")
    return repo.join(tag, "repo").select(
        "repo", "tag", F.concat(F.lit(f"{registry}/"), "repo", F.lit(":"), "tag").alias("image")
    )
