"""Queries over rows that earlier filters left out."""

import re
import zlib

from pyspark.sql import functions as F

from gridmark.plans import registry

SF = "/root/testdata/sf0.001"


def test_word_overlap_of_long_documents(spark, tmp_path):
    words = ["ALPHA", "BRAVO", "CHARLIE", "DELTA", "ECHO", "FOXTROT", "to", "abc"]
    docs = [(i, " ".join(words[(i + j) % 8] for j in range(n))) for i, n in enumerate((1, 3, 5, 60, 200, 2000))]
    items = [(i, f"{words[i]} {words[i + 1]} {words[i + 2]}") for i in range(5)]
    spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = lambda t: {w.upper().rstrip("S") for w in re.findall("[A-Z]{4,}", t.upper())}
    want = sorted((d, i, len(own(t) & own(u))) for d, t in docs for i, u in items if own(t) & own(u))
    assert any(d >= 3 for d, _, _ in want)
    got = registry.QUERIES["word_overlap_all"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.item_id, r.shared) for r in got) == want


def _bars_of_many_parts(spark, path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.withColumn("l_partkey", (F.col("l_partkey") * 97 + 2600).cast(lines.schema["l_partkey"].dataType)).write.parquet(f"{path}/lineitem.parquet")
    return [r.asDict() for r in registry._bars(spark, str(path)).collect()]


def test_name_split_of_all_elements(spark, tmp_path):
    names = {b["element"] for b in _bars_of_many_parts(spark, tmp_path)}
    assert any(int(n.split("-")[1]) >= 100 for n in names)
    got = registry.QUERIES["name_split"](spark, str(tmp_path)).collect()
    split = lambda n: f"{n};{n}" if int(n.split("-")[1]) < 100 else ""  # a name has two digits at most
    assert sorted((r.title, r.names) for r in got) == sorted((f"{n.replace('-', '/')}, {n}", split(n)) for n in names)


def test_sheet_key_sets_of_all_bars(spark):
    sides = {}
    for b in registry._bars(spark, SF).collect():
        sides.setdefault(b.feuillet, {"plan": set(), "atelier": set()})[b.source].add(b.element)
    want = sorted((f, len(s["plan"]), len(s["atelier"]), len(s["plan"] & s["atelier"]), len(s["plan"] - s["atelier"]), len(s["atelier"] - s["plan"])) for f, s in sides.items())
    got = registry.QUERIES["sheet_key_sets_all"](spark, SF).collect()
    assert sorted((r.feuillet, r.plan, r.atelier, r.paired, r.plan_only, r.atelier_only) for r in got) == want


def test_refile_reads_all_sheets_of_both_sides(spark):
    names = {(b.source, b.feuillet, b.element) for b in registry._bars(spark, SF).collect()}
    plans = {n[1:] for n in names if n[0] == "plan"}
    shops = sorted((n[1:] for n in names if n[0] == "atelier"), key=lambda n: zlib.crc32("".join(n).encode()))
    storey, taken, want = {"S-500": 1, "S-501": 1, "S-502": 2, "S-503": 2}, set(shops), []
    for sheet, element in shops:
        homes = [s for s in storey if storey[s] == storey[sheet] and s != sheet and (s, element) in plans and (s, element) not in taken]
        to = homes[0] if len(homes) == 1 and (sheet, element) not in plans else sheet
        taken.add((to, element))
        want.append((to, element, to != sheet))
    got = registry.QUERIES["refile"](spark, SF).collect()
    assert {f for f, _, _ in want} == set(storey)
    assert sorted((r.feuillet, r.element, r.moved) for r in got) == sorted(want)
