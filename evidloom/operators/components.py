"""Component inventories: projection of nested components, gaps and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidloom.functions import text as TX

COMPONENT = (
    "struct<`bom-ref`:string,name:string,version:string,purl:string,licenses:array<struct<expression:string,license:struct<id:string,name:string>>>,hashes:array<struct<alg:string,content:string>>>"
)
INVENTORY = f"struct<bomFormat:string,specVersion:string,components:array<{COMPONENT}>>"
VERSIONS = ("1.4", "1.5", "1.6")


def inventory_problems(df: DataFrame, key: str, json: str, most: int = 2000) -> DataFrame:
    """(key, problem) of inventories that are not to be read: no JSON, another format or version, too many components, or
    a repeated bom-ref."""
    p = F.from_json(F.col(json), INVENTORY)
    refs = F.filter(F.transform("_p.components", lambda c: c["bom-ref"]), lambda r: r.isNotNull())
    problem = (
        F.when(F.col("_p").isNull() | F.col("_p.bomFormat").isNull(), "unreadable")
        .when(F.col("_p.bomFormat") != "CycloneDX", "format")
        .when(~F.col("_p.specVersion").isin(*VERSIONS) | F.col("_p.specVersion").isNull(), "version")
        .when(F.size("_p.components") > most, "too_many_components")
        .when(F.size(refs) != F.size(F.array_distinct(refs)), "repeated_ref")
    )
    return df.select(key, p.alias("_p")).select(key, problem.alias("problem")).where("problem is not null")


def components(df: DataFrame, key: str, json: str, most_each: int = 12) -> DataFrame:
    """(key, no, name, version, purl, licenses, hashes): one row per component of a JSON inventory; of at most `most_each`
    licences (expression before id before name) and hashes the distinct ones, sorted."""
    rows = df.select(key, F.posexplode(F.from_json(F.col(json), INVENTORY)["components"]).alias("_i", "_c"))
    licence = F.transform(F.slice(F.coalesce("_c.licenses", F.array()), 1, most_each), lambda x: F.coalesce(F.nullif(F.trim(x["expression"]), F.lit("")), F.nullif(F.trim(x["license"]["id"]), F.lit("")), F.nullif(F.trim(x["license"]["name"]), F.lit(""))))
    hashes = F.filter(F.slice(F.coalesce("_c.hashes", F.array()), 1, most_each), lambda h: (F.trim(h["alg"]) != "") & (F.trim(h["content"]) != ""))
    field = lambda c: F.trim(F.coalesce(F.col(f"_c.{c}"), F.lit(""))).alias(c)
    return rows.select(key, (F.col("_i") + 1).alias("no"), field("name"), field("version"), field("purl"), F.array_sort(F.array_distinct(F.array_compact(licence))).alias("licenses"), F.array_sort(F.array_distinct(hashes)).alias("hashes"))


def identity(*columns: str):
    return F.concat_ws("\n", *(TX.casefold(F.coalesce(F.col(c), F.lit(""))) for c in columns))


def duplicate_groups(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, copy_no, copies): rows that agree in all columns, letter case aside, numbered by key. The group sizes are
    aggregated, not windowed over whole rows."""
    tagged = df.select(key, F.sha2(identity(*columns), 256).alias("_g"))
    sizes = tagged.groupBy("_g").agg(F.count("*").alias("copies"))
    again = tagged.join(sizes.where("copies > 1"), "_g")
    return again.select(key, F.row_number().over(Window.partitionBy("_g").orderBy(key)).alias("copy_no"), "copies")


def gaps(df: DataFrame, key: str, columns: list[str] = ("name", "version", "purl")) -> DataFrame:
    """(key, gap): what each component lacks, and whether it has copies."""
    dup = duplicate_groups(df, key, list(columns)).select(key, F.lit(True).alias("_dup"))
    joined = df.join(dup, key, "left")
    missing = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("version", F.lit(""))) == "", F.lit("missing_version")),
            F.when(F.size(F.coalesce("licenses", F.array())) == 0, F.lit("missing_license")),
            F.when(F.size(F.coalesce("hashes", F.array())) == 0, F.lit("missing_checksum")),
            F.when(F.trim(F.coalesce("purl", F.lit(""))) == "", F.lit("unknown_package_id")),
            F.when(F.col("_dup"), F.lit("duplicate_component")),
        )
    )
    return joined.select(key, F.explode(missing).alias("gap"))
