"""Notation: values as they are written on drawings, and what they mean."""

import pytest
from pyspark.sql import functions as F

from gridmark.functions import text as T


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


def bars(got):
    return [(b.repere, b.diametre, b.quantite, b.espacement_mm, b.longueur_mm) for b in got]


@pytest.mark.parametrize("text,key", [
    ("PLAN DES COLONNES - REZ-DE-CHAUSSÉE", "RDC"), ("COLONNES - NIVEAU 12", "N12"), ("NIV. 3", "N3"), ("X - SOUS-SOL", "SS"), ("X - SOUS-SOL S2", "SS2"),
    ("SS1", "SS1"), ("TOIT  TERRASSE", "TOIT TERRASSE"), ("NOTES GÉNÉRALES", None), (None, None),
])
def test_storey(spark, text, key):
    assert value(spark, T.storey_key, text) == key


def test_octal(spark):
    got = value(spark, T.octal_decoded, "PLAN - REZ-DE-CHAUSS\\311E\x00 \\3")
    assert got == "PLAN - REZ-DE-CHAUSSÉE \\3"
    assert value(spark, T.octal_decoded, None) == ""


@pytest.mark.parametrize("stem,key", [
    ("XX_COLONNE-NIV-2@3", "N2"), ("XX_COLONNES NIV 10", "N10"), ("XX-NIV-SS1@RDC", "SS1"), ("XX-NIV-RDC@2", "RDC"), ("XX-NIV-FDN@SS2", "FDN"), ("XX_COLONNES Partie 1", None),
])
def test_lift(spark, stem, key):
    assert value(spark, T.lift_storey, stem) == key


def test_tags(spark):
    got = value(spark, T.tag_bars, 'COL. 16"x24"\nARM.: 4-25M +GOUJ.\nLIG.: 10M@6" c/c\nBÉTON: 35MPa')
    assert bars(got) == [(None, "25M", 4, None, None), (None, "10M", None, 152.0, None)]
    assert bars(value(spark, T.tag_bars, "LIG.: 10M@300 c/c"))[0][3] == 300


@pytest.mark.parametrize("text,want", [
    ("VERT: 4 25M 25M12-06", ("25M12-06", "25M", 4, None, 3810.0)), ('ÉTRI: 14 10M 10MT16X24 @6"', ("10MT16X24", "10M", 14, 152.0, None)), ("NIVEAU 2", None),
])
def test_table_lines(spark, text, want):
    got = value(spark, T.table_bar, text)
    assert (got and bars([got])[0]) == want


def test_callouts(spark):
    assert bars(value(spark, T.plan_bars, "4-25M +GOUJ.")) == [(None, "25M", 4, None, None)]
    got = value(spark, lambda t: T.plan_bars(t, F.lit("BAS")), 'RANG 1: 20M@12" c/c')
    assert bars(got) == [("BAS", "20M", None, 305.0, None)]
    assert bars(value(spark, T.plan_bars, "15M @300 c/c"))[0][3] == 300 and value(spark, T.plan_bars, "NIVEAU 2") == []


def test_shop_lines(spark):
    got = value(spark, T.shop_bar, "LONG: 9 20M 20M9-06")
    assert got.key == "LONG" and bars([got.bar]) == [("LONG 20M9-06", "20M", 9, None, None)]
    got = value(spark, T.shop_bar, '12 10M 10MET12X20 @7 1/2"c.c.')
    assert got.key is None and got.bar.espacement_mm == 190  # half to even
    assert value(spark, T.shop_bar, "COLONNE A-6, 16X24:") is None


def test_names(spark):
    assert value(spark, T.detail_names, "C.5-12, D.5 / 12") == ["C.5-12", "D.5-12"]
    assert value(spark, T.detail_names, "VOIR C-12") == []
    assert value(spark, T.label_key, " s-500 , c,5 ") == "S500.C.5"


@pytest.mark.parametrize("folder,stem,kind", [
    ("Refends", "XX_CONCENTRATION COLONNES - RDC", "mur"), ("Semelles et radiers", "XX_RADIERS 1@2", "fondation"), ("DA", "XX_POUTRES RDC", "poutre"), ("Dalles", "XX_NIV 22", "dalle"), ("DA", "XX_NOTES", None),
])
def test_kinds(spark, folder, stem, kind):
    assert spark.createDataFrame([(folder, stem)], "f string, s string").select(T.kind_of_drawing("f", "s").alias("k")).first().k == kind


def test_roles_and_units(spark):
    assert [value(spark, T.bar_role, t) for t in ("LONG 20M9-06", "BANDE", "25M12-06", "X", None)] == ["LONG", "BANDE", "", "", ""]
    mm = lambda v, u: spark.range(1).select(T.spacing_mm(F.lit(float(v)), F.lit(u)).alias("v")).first().v
    assert [mm(6, ""), mm(300, ""), mm(6, "mm"), mm(7.5, '"')] == [152, 300, 6, 190]
    assert value(spark, T.number_tokens, " ÉTRI: 11 10M x ") == ["11", "10M"] and value(spark, T.title_words, "Rez-de-chaussées TRÉFOND") == ["CHAUSSEE", "TREFOND"]
