"""Records of elements: JSON in and out, lenient reading, strict writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BAR, record_source

RECORD = f"id string, source string, fichier string, feuillet string, page int, x double, y double, type_element string, element string, armature array<{BAR}>"
#: as read: numbers may stand as texts or with decimals
_READ = (
    "array<struct<id: string, source: string, fichier: string, feuillet: string, page: string, x: string, y: string, type_element: string,"
    " element: string, armature: array<struct<repere: string, diametre: string, quantite: string, espacement_mm: string, longueur_mm: string>>>>"
)
SOURCES, TYPES = ("plan", "atelier"), ("fondation", "poutre", "mur", "colonne", "dalle")


def _whole(x: Column) -> Column:
    return x.cast("double").cast("int")


def coerced(r: Column) -> Column:
    """A record as read, with defaults for absent fields; bars keep their nulls but for texts."""
    text = lambda c: F.coalesce(c, F.lit(""))
    bars = F.transform(
        F.coalesce(r["armature"], F.array()),
        lambda b: F.struct(
            text(b["repere"]).alias("repere"), text(b["diametre"]).alias("diametre"), _whole(b["quantite"]).alias("quantite"),
            b["espacement_mm"].cast("double").alias("espacement_mm"), b["longueur_mm"].cast("double").alias("longueur_mm"),
        ),
    )
    zero = lambda c, kind: F.coalesce(F.nullif(c, F.lit("")).cast("double"), F.lit(0.0)).cast(kind)
    return F.struct(
        text(r["id"]).alias("id"), record_source(text(r["source"]), text(r["id"])).alias("source"), text(r["fichier"]).alias("fichier"),
        text(r["feuillet"]).alias("feuillet"), zero(r["page"], "int").alias("page"), zero(r["x"], "double").alias("x"), zero(r["y"], "double").alias("y"),
        text(r["type_element"]).alias("type_element"), text(r["element"]).alias("element"), bars.alias("armature"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that hold one JSON array each, with ``ord``, their place in the file."""
    files = spark.read.text(path, wholetext=True)
    rows = files.select(F.posexplode(F.from_json("value", _READ, {"mode": "FAILFAST"})).alias("ord", "r"))
    return rows.select(F.col("ord").cast("long"), coerced(F.col("r")).alias("r")).select("ord", "r.*")


def checked(records: DataFrame) -> DataFrame:
    """Strict form for writing: known sides and types, whole millimetres; raises on anything else."""
    bad = ~F.col("source").isin(*SOURCES) | ~F.col("type_element").isin(*TYPES)
    bars = F.transform("armature", lambda b: F.struct(b["repere"], b["diametre"], b["quantite"], b["espacement_mm"].cast("int").alias("espacement_mm"), b["longueur_mm"].cast("int").alias("longueur_mm")))
    fail = F.raise_error(F.concat(F.lit("not a record: "), F.coalesce("id", F.lit("null"))))
    return records.withColumn("source", F.when(bad, fail.cast("string")).otherwise(F.col("source"))).withColumn("armature", bars)


def write_records(records: DataFrame, path: str, one_array: bool = False) -> None:
    """JSON lines, or with ``one_array`` a single JSON array in the order of ``ord`` (small tables only)."""
    out = checked(records)
    if one_array:
        rows = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*[c for c in out.columns if c != "ord"]).alias("r")))), lambda x: x["r"])
        out.agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    else:
        out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
