"""Pairing and comparison, against the stated examples and a plain model of the rules."""

import random

import pytest

from gridmark.operators import comparing as C
from gridmark.operators import pairing as P
from gridmark.operators import reporting as R
from gridmark.sources.records import RECORD, read_records, write_records


def bar(d, q=None, sp=None, length=None, mark=""):
    return {"repere": mark, "diametre": d, "quantite": q, "espacement_mm": sp, "longueur_mm": length}


def fields(plan, shop, kind="colonne"):
    return [f for x in C.judge(plan, shop, kind) for f in x["ecarts"]]


@pytest.mark.parametrize("plan,shop,kind,want", [
    ([bar("25M", 8)], [bar("25m", 8)], "colonne", []),
    ([bar("25M", 9)], [bar("25M", 11)], "colonne", ["quantite"]),
    ([bar("35M", 8)], [bar("25M", 8)], "colonne", ["diametre"]),
    ([bar("10M", None, 304.8)], [bar("10M", None, 152.4)], "fondation", ["espacement_mm"]),
    ([bar("25M", 8)], [bar("25M", 8, None, 3810)], "colonne", []),
    ([bar("25M", 4)], [bar("25M")], "colonne", ["quantite"]),
    ([bar("25M", 8), bar("10M", None, 152)], [bar("10M", 3, 152), bar("25M", 8), bar("10M", 3)], "colonne", []),
    ([bar("25M", 8)], [bar("25M", 4), bar("25M", 4)], "colonne", []),
    ([bar("25M", 8)], [bar("25M", 4), bar("25M", 2)], "colonne", ["quantite"]),
    ([bar("10M", None, 152)], [bar("10M", 9, 152), bar("10M", 9, 305)], "colonne", ["espacement_mm"]),
    ([bar("10M", None, 300)], [bar("10M", 9, 150), bar("10M", 9, 300)], "colonne", []),
    ([bar("10M", None, 300)], [bar("10M", 9, 150)], "colonne", ["espacement_mm"]),
    ([bar("25M", 8)], [bar("25M", 8), bar("20M", 4, mark="GOUJ 20M")], "colonne", []),
    ([bar("25M", 8)], [], "colonne", ["barre"]),
    ([bar("25M", 8)], [bar("25M", 8), bar("30M", 2)], "colonne", ["barre"]),
    ([bar("20M", 12, mark="LONG"), bar("20M", 10, mark="TRAN")], [bar("20M", 12, mark="LONG 20M9"), bar("20M", 12, mark="TRAN 20M9"), bar("15M", 4, mark="GOUJ X"), bar("10M", 2, mark="ATT Y")], "fondation", ["quantite"]),
    ([bar("10M", None, 305)], [bar("10M", None, 254)], "fondation", ["espacement_mm"]),
    ([bar("10M", None, 305)], [bar("10M", None, 254), bar("10M", None, 305)], "colonne", []),
    ([bar("10M", None, 305)], [bar("10M", None, 254), bar("10M", None, 305)], "dalle", ["barre"]),
])
def test_examples(plan, shop, kind, want):
    assert fields(plan, shop, kind) == want


def card(ord_, source, sheet, element, kind="colonne", bars=()):
    return (ord_, f"{sheet}_{element}_{source}", source, "f", sheet, 1, 0.0, 0.0, kind, element, [tuple(b.values()) for b in bars])


def test_pairing_model(spark):
    rng = random.Random(22)
    cards = [card(i, rng.choice(["plan", "atelier", "autre"]), rng.choice(["S-1", "s1"]), rng.choice("ABCDEFGH"), rng.choice(["mur", "dalle", "", "Mur"])) for i in range(300)]
    df = spark.createDataFrame(cards, "ord long, " + RECORD)
    got = sorted((r.statut, r.plan.ord if r.plan else -1, r.atelier.ord if r.atelier else -1) for r in P.pair_records(df).collect())
    label = lambda c: (c[4].upper().replace("-", ""), c[9])
    used, want = set(), []
    for p in cards:
        if p[2] == "plan":
            near = [a for a in cards if a[2] == "atelier" and label(a) == label(p)]
            same = [a for a in near if p[8] and a[8].upper() == p[8].upper()]
            free = [a for a in same or near if a[0] not in used]
            want.append(("paire", p[0], free[0][0]) if free else ("manquant", p[0], -1))
            if free:
                used.add(free[0][0])
    want += [("ajoute", -1, a[0]) for a in cards if a[2] == "atelier" and a[0] not in used]
    assert got == sorted(want)


def test_judged_and_reported(spark, tmp_path):
    cards = [
        card(1, "plan", "S-500", "C-12", bars=[bar("25M", 8)]), card(2, "atelier", "s500", "c12", bars=[bar("25M", 4), bar("25M", 4)]),
        card(3, "plan", "S-100", "A-1", "fondation", [bar("20M", 9)]), card(4, "atelier", "S-100", "A-1", "fondation", [bar("20M", 11)]),
        card(5, "plan", "S-100", "A-2", "fondation", [bar("20M", 9), bar("15M", None, 300.0)]), card(6, "atelier", "S-200", "Z", "mur"), card(7, "plan", "S-900", "Q", "mur"),
    ]
    df = spark.createDataFrame(cards, "ord long, " + RECORD)
    write_records(df, str(tmp_path / "r"), one_array=True)
    again = read_records(spark, str(tmp_path / "r"))
    assert sorted(r.id for r in again.collect()) == sorted(c[1] for c in cards)
    judged = C.judged(P.pair_records(again))
    sheets = {r.feuillet: r for r in R.by_sheet(judged).collect()}
    assert (sheets["S-500"].conforme, sheets["S-500"].a_signaler) == (1, 0) and (sheets["S-100"].conforme, sheets["S-100"].a_signaler) == (0, 2)
    assert sheets["S-200"].ajoute == 1 and sheets["S-900"].sans_atelier and not sheets["S-100"].sans_atelier and sheets["S-100"].types == "fondation"
    rows = R.report_rows(judged).collect()
    of = lambda e: [r for r in rows if r.etiquette == e]
    assert not of("S-500 C-12") and len(of("S-100 A-2")) == 2 and of("S-100 A-2")[0].origine_atelier == "x" and all(r.en_ecart for r in of("S-100 A-2"))
    (r,) = of("S-100 A-1")
    assert r.quantite == "9 | 11" and r.quantite_ecart and not r.diametre_ecart and r.en_ecart
    assert len(of("S-200 Z")) == 1 and of("S-200 Z")[0].diametre == "x | x"


def test_fusion(spark):
    rows = [("k", "LONG a", "20m", 4, None, 100.0), ("k", "LONG b", "20M", None, None, 100.0), ("k", "LONG a", "25M", 1, 152.44, 1.0), ("k", "LONG a", "25M", 2, 152.41, 2.0)]
    df = spark.createDataFrame(rows, "key string, repere string, diametre string, quantite int, espacement_mm double, longueur_mm double")
    got = {r.diametre_n: (r.quantite, r.longueur_mm, r.repere) for r in C.fused(df, ["key"]).collect()}
    assert got == {"20M": (None, 100.0, "LONG a + LONG b"), "25M": (3, None, "LONG a")}
