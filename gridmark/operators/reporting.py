"""Reports: verdicts by sheet, rows of bars, cross-tabulations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import cell_pair

FIELDS = ("repere", "diametre", "quantite", "espacement_mm", "longueur_mm")
STATUSES = ("conforme", "non_conforme", "manquant", "ajoute")


def sheet_of() -> Column:
    """A verdict's sheet: the plan record's, else the shop record's, else its label's."""
    own = F.coalesce(F.nullif("plan.feuillet", F.lit("")), F.when(F.col("plan").isNull(), F.nullif("atelier.feuillet", F.lit(""))))
    return F.coalesce(own, F.col("feuillet_n"))


def by_sheet(verdicts: DataFrame) -> DataFrame:
    """Counts of each sheet: compliant, not compliant (all others), by status, types, no shop drawing."""
    kind = F.coalesce("plan.type_element", "atelier.type_element")
    s = F.col("statut")
    out = verdicts.groupBy(sheet_of().alias("feuillet")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(s == x).alias(x) for x in STATUSES],
        F.array_join(F.sort_array(F.collect_set(F.nullif(kind, F.lit("")))), ", ").alias("types"), F.bool_and(s == "manquant").alias("sans_atelier"),
    )
    return out.withColumn("a_signaler", F.col("n") - F.col("conforme"))


def origin(card: str) -> Column:
    c = F.col(card)
    return F.when(c.isNull(), "x").otherwise(F.format_string("%s | page %s, x %s, y %s", c["fichier"], c["page"].cast("string"), c["x"].cast("string"), c["y"].cast("string")))


def report_rows(judged: DataFrame) -> DataFrame:
    """A row for each aligned bar of verdicts to be reported; an element without bars has one empty row."""
    alone = F.col("plan").isNull() | F.col("atelier").isNull()
    rows = judged.filter("statut <> 'conforme'").withColumn("barre", F.explode_outer("barres"))
    flags = F.coalesce(F.col("barre.ecarts"), F.array().cast("array<string>"))
    marked = lambda f: ~alone & (F.array_contains(flags, f) | F.array_contains(flags, "barre"))
    name = F.coalesce("plan.element", "atelier.element", "element_n")
    return rows.select(
        sheet_of().alias("feuillet"), F.concat_ws(" ", sheet_of(), name).alias("etiquette"), origin("plan").alias("origine_plan"), origin("atelier").alias("origine_atelier"),
        *[cell_pair(F.col(f"barre.plan.{f}"), F.col(f"barre.atelier.{f}")).alias(f) for f in FIELDS],
        *[marked(f).alias(f"{f}_ecart") for f in FIELDS], "statut", (alone | (F.size(flags) > 0)).alias("en_ecart"),
    )


def cross_tab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``column`` values for each ``row``, and a total row (null)."""
    return df.rollup(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values], F.count(F.lit(1)).alias("total"))


def name_sets(records: DataFrame) -> DataFrame:
    """For each sheet how many names either side has, shares, and has alone."""
    sides = records.groupBy("feuillet", "element").agg(F.bool_or(F.col("source") == "plan").alias("p"), F.bool_or(F.col("source") == "atelier").alias("a"))
    return sides.groupBy("feuillet").agg(F.count_if("p").alias("plan"), F.count_if("a").alias("atelier"), F.count_if(F.col("p") & F.col("a")).alias("paired"), F.count_if(F.col("p") & ~F.col("a")).alias("plan_only"), F.count_if(F.col("a") & ~F.col("p")).alias("atelier_only"))


def mats(bars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One bar for each mark, diameter and spacing, the last one in ``order``."""
    unique = ["repere", "diametre", "espacement_mm"]
    rest = [c for c in bars.columns if c not in (*keys, *unique, order)]
    return bars.groupBy(*keys, *unique).agg(*[F.max_by(c, order).alias(c) for c in rest])


def expanded_range(text: Column) -> Column:
    """The storeys of a title: each of a range, else the one number."""
    span = r"NIVEAU\s+(\d+)\s*@\s*(\d+)"
    n = lambda i: F.nullif(F.regexp_extract(text, span, i), F.lit("")).cast("int")
    return F.when(text.rlike(span) & (n(1) <= n(2)), F.transform(F.sequence(n(1), n(2)), lambda x: F.concat(F.lit("N"), x.cast("string"))))


__all__ = ["FIELDS", "STATUSES", "K", "by_sheet", "cross_tab", "expanded_range", "mats", "name_sets", "origin", "report_rows", "sheet_of"]
