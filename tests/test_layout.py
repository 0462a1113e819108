"""Layout, grid, matching and readings on small pages."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridmark.operators import gridlines as G
from gridmark.operators import layout as L
from gridmark.operators import matching as M
from gridmark.operators import ocr as O

KEYS = ["page"]
LINE = "page int, line_id int, x0 double, y0 double, x1 double, y1 double, text string"


def lines(spark, rows, width=60.0, height=8.0):
    return spark.createDataFrame([(1, i, float(x), float(y), x + width, y + height, t) for i, (x, y, t) in enumerate(rows)], LINE)


def titled(spark, rows):
    return lines(spark, rows).withColumn("title_id", F.col("line_id"))


def centred(df):
    return df.withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2})


def test_share_by_title(spark):
    bars = centred(lines(spark, [(x, 50, "b") for x in (60, 150, 240, 330, 470, 560)] + [(60, 500, "low")]))
    titles = titled(spark, [(100, 300, "A"), (500, 305, "B")])
    got = sorted((r.title_id, r.line_id) for r in L.share_by_title(bars, titles, KEYS).collect())
    assert got == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 4), (1, 5)]


def test_nearest_title(spark):
    pts = centred(lines(spark, [(820, 300, "a"), (150, 100, "b")]))
    titles = titled(spark, [(100, 400, "A"), (900, 650, "B")])
    assert sorted((r.line_id, r.title_id) for r in L.share_by_title_under(pts, titles, KEYS).collect()) == [(0, 1), (1, 0)]


def test_stacks_and_runs(spark):
    df = lines(spark, [(10, 10, "a"), (11, 19, "b"), (10, 28, "c"), (300, 28, "d")])
    sizes = sorted(r["count"] for r in L.stacked(df, KEYS).groupBy("block").count().collect())
    assert sizes == [1, 3]
    s = spark.createDataFrame([(1, 100.0, 300.0), (1, 290.0, 480.0), (1, 600.0, 700.0)], "page int, x0 double, x1 double")
    assert sorted((r.x0, r.x1) for r in L.covered_runs(s, KEYS).collect()) == [(100, 480), (600, 700)]


def test_beams(spark):
    df = lines(spark, [(100, 300, 'P101 - 16" x 24"'), (300, 300, "P-12: 400x600"), (600, 300, "P103 - 4"), (0, 0, "S-300 - ÉLÉVATIONS"), (0, 20, "3-25M")])
    t = L.span_titles(df).withColumn("title_id", F.col("line_id"))
    assert sorted(r.name for r in t.collect()) == ["P-12", "P101", "P103"]
    strokes = spark.createDataFrame([(1, 90.0, 400.0, 250.0), (1, 590.0, 700.0, 250.0)], "page int, x0 double, x1 double, y double")
    assert sorted((r.name, r.spans) for r in L.continuous_beams(t, strokes, KEYS).collect()) == [("P101+P-12", [0, 1]), ("P103", [2])]


def test_schedule(spark):
    rows = [(200, 100, "ARM. LONG."), (400, 100, "ARM. TRANSV."), (50, 120, "TYPE A"), (50, 150, "TYPE B"), (200, 120, "12-20M"), (400, 120, "10-20M"), (200, 150, "8-15M"), (200, 160, "+ ÉP. 15M@300"), (400, 150, "8-15M"), (700, 150, "9-15M")]
    got = {}
    for r in L.schedule_cells(lines(spark, rows), KEYS).orderBy("line_y").collect():
        got.setdefault((r.type, r.role), []).extend((b.quantite, b.espacement_mm) for b in r.bars)
    assert got == {("A", "LONG"): [(12, None)], ("A", "TRAN"): [(10, None)], ("B", "LONG"): [(8, None), (None, 300)], ("B", "TRAN"): [(8, None)]}


def test_titles_of_rafts_and_walls(spark):
    sized = lines(spark, [(0, 0, "RADIER #2"), (0, 50, "VOIR RADIER #3"), *[(0, 100 + 10 * i, "note") for i in range(5)]]).withColumn("size", F.when(F.col("line_id") == 0, 20.0).otherwise(8.0))
    assert [r.raft for r in L.raft_titles(sized, KEYS).collect()] == ["2"]
    w = lines(spark, [(300, 10, "ÉLÉVATION"), (200, 10, "B"), (300, 400, "ÉLÉVATION - MUR C - S.S2"), (300, 500, "ÉLÉVATION X")]).withColumn("size", F.when(F.col("line_id") == 1, 30.0).when(F.col("line_id") == 3, 5.0).otherwise(12.0))
    assert sorted(r.wall for r in L.wall_titles(w, KEYS).collect()) == ["B", "C"]


def test_storeys(spark):
    pts = lines(spark, [(0, 150, "a"), (0, 350, "b")])
    labels = spark.createDataFrame([(1, 100.0, "NIVEAU 2"), (1, 300.0, "RDC"), (1, 320.0, "NOTE")], "page int, label_y double, text string")
    assert sorted((r.line_id, r.storey) for r in L.storeys_under(pts, labels, KEYS).collect()) == [(0, "RDC"), (1, "FDN")]


def test_grid_names(spark):
    v = spark.createDataFrame([(1, 100.0, "1"), (1, 300.0, "2"), (1, 500.0, "3")], "page int, position double, label string")
    h = spark.createDataFrame([(1, 50.0, "A"), (1, 250.0, "B")], "page int, position double, label string")
    p = spark.createDataFrame([(1, 1, 300.0, 50.0), (1, 2, 180.0, 250.0), (1, 3, 900.0, 250.0)], "page int, id int, x double, y double")
    assert sorted((r.id, r.name, r.derived) for r in G.grid_names(p, v, h, KEYS, "id").collect()) == [(1, "A-2", False), (2, "B-1.4", True), (3, None, False)]


def test_shop_and_plan_grid(spark):
    words = [(1, 100.0 * i, 20.0, c) for i, c in enumerate("ABCDE", 1)] + [(1, 20.0, 100.0 * i, str(i)) for i in range(1, 5)] + [(1, 230.0, 150.0, "9"), (1, 250.0, 152.0, "3"), (1, 300.0, 151.0, "7")]
    df = spark.createDataFrame(words, "page int, x double, y double, text string")
    got = {}
    for r in G.shop_grid(df, KEYS).collect():
        got.setdefault(r.axis, {})[r.position] = r.label
    assert got == {"v": {100.0 * i: c for i, c in enumerate("ABCDE", 1)}, "h": {100.0 * i: str(i) for i in range(1, 5)}}
    both = spark.createDataFrame([(1, 100.0 * i, y, c) for i, c in enumerate("ABCDEF", 1) for y in (20.0, 900.0)] + [(1, x, 100.0 * i, str(i)) for i in range(1, 8) for x in (20.0, 905.0)], "page int, x double, y double, text string")
    got = sorted((r.axis, r.label) for r in G.plan_grid(both, KEYS).collect())
    assert got == sorted([("v", c) for c in "ABCDEF"] + [("h", str(i)) for i in range(1, 8)])


def test_longest_run_model():
    rng = np.random.default_rng(23)
    for _ in range(60):
        found = [(float(i), str(rng.integers(1, 9))) for i in range(8)]
        run = G.longest_run(found)
        best = 0
        for way in (found, found[::-1]):
            for mask in range(256):
                pick = [int(t) for i, (_, t) in enumerate(way) if mask >> i & 1]
                if all(a < b for a, b in zip(pick, pick[1:], strict=False)):
                    best = max(best, len(pick))
        assert len(run) == best


def test_mapping(spark):
    a = spark.createDataFrame([(1, 0.0, "1"), (1, 100.0, "2"), (1, 200.0, "3"), (1, 300.0, "4")], "page int, position double, label string")
    b = spark.createDataFrame([(1, 10.0, "1"), (1, 60.0, "2"), (1, 160.0, "4")], "page int, position double, label string")
    p = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((50, 250, -100, 400))], "page int, id int, x double")
    assert [r.mapped for r in sorted(G.axis_map(a, b, p, KEYS, "id", "x").collect(), key=lambda r: r.id)] == [35.0, 135.0, -40.0, 210.0]
    assert {r.mapped for r in G.axis_map(a, b.limit(1), p, KEYS, "id", "x").collect()} == {None}


def greedy_model(pairs):
    left, right, out = set(), set(), []
    for *_, a, b in sorted(pairs):
        if a not in left and b not in right:
            out.append((a, b))
            left.add(a)
            right.add(b)
    return sorted(out)


def test_two_phase(spark):
    calls = [(1, 0, 0.0, 0.0, True, 8, 4), (1, 1, 10.0, 0.0, True, 12, 6)]
    c = spark.createDataFrame(calls, "page int, callout_id int, x double, y double, lettered boolean, quantity int, band int")
    g = lambda q: spark.createDataFrame([(1, 0, 1.0, 0.0, True, q[0], 6), (1, 1, 9.0, 0.0, True, q[1], 4)], "page int, group_id int, x double, y double, lettered boolean, quantities array<int>, band int")
    assert sorted((r.group_id, r.callout_id) for r in M.pair_callouts(c, g([[12], [8]]), KEYS, 50.0).collect()) == [(0, 1), (1, 0)]
    assert sorted((r.group_id, r.callout_id) for r in M.pair_callouts(c, g([[1], [2]]), KEYS, 50.0).collect()) == [(0, 0), (1, 1)]


def test_nearest_model(spark):
    rng = np.random.default_rng(24)
    cols, tags = rng.uniform(0, 400, (12, 2)).round(1), rng.uniform(0, 400, (10, 2)).round(1)
    box = lambda p, name: spark.createDataFrame([(1, i, float(x), float(y), float(x) + 10, float(y) + 10) for i, (x, y) in enumerate(p)], f"page int, {name} int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.column_id, r.tag_id) for r in M.match_nearest(box(cols, "column_id"), box(tags, "tag_id"), KEYS).collect())
    gap = lambda a, b: float(np.hypot(*np.maximum(np.abs(a - b) - 10, 0)))
    pairs = [(gap(a, b), i, j) for i, a in enumerate(cols) for j, b in enumerate(tags) if gap(a, b) < 150]
    assert got == greedy_model([(round(d, 6), i, j, i, j) for d, i, j in pairs])


def test_leaders(spark):
    box = "page int, {} int, x0 double, y0 double, x1 double, y1 double"
    c = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 500.0, 500.0, 510.0, 510.0)], box.format("column_id"))
    t = spark.createDataFrame([(1, 7, 200.0, 200.0, 260.0, 220.0), (1, 8, 30.0, 600.0, 60.0, 620.0)], box.format("tag_id"))
    s = spark.createDataFrame([(1, 0, 5.0, 5.0, 100.0, 100.0), (1, 1, 100.5, 100.2, 150.0, 200.0), (1, 2, 190.0, 205.0, 150.3, 200.1)], "page int, seg_id int, ax double, ay double, bx double, by double")
    assert [(r.column_id, r.tag_id) for r in M.follow_leaders(c, t, s, KEYS).collect()] == [(0, 7)]


def test_piles(spark):
    rows = [(1, 0, 0.0, 0.0, 60.0, 8.0, False), (1, 1, 0.0, 10.0, 60.0, 18.0, False), (1, 2, 300.0, 0.0, 360.0, 8.0, False)]
    schema = "page int, {} int, x0 double, y0 double, x1 double, y1 double, upright boolean"
    bands = [(1, 9, 0.0, 20.0, 60.0, 28.0, False)]
    (r,) = M.label_piles(spark.createDataFrame(rows, schema.format("label_id")), spark.createDataFrame(bands, schema.format("band_id")), KEYS).collect()
    assert (r.band_id, r.label_id, r.pile) == (9, 1, [0])


def reading(text, score, x0, y0, x1, y1, cut=False, vertical=False):
    return {"score": score, "cut": cut, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "text": text, "vertical": vertical}


@pytest.mark.parametrize("rows,want", [
    ([reading("QTE :", 1.0, 0, 0, 50, 10), reading("QTE : 1", 0.95, 0, 0, 70, 10)], ["QTE : 1"]),
    ([reading("25M", 1.0, 0, 0, 30, 10), reading("Z5M 1", 0.9, 0, 0, 45, 10)], ["25M"]),
    ([reading("A", 0.9, 0, 0, 10, 10), reading("", 1.0, 0, 0, 10, 10), reading("B", 0.5, 100, 0, 110, 10)], ["A", "B"]),
])
def test_duplicates(rows, want):
    page = pd.DataFrame(rows)
    assert [page.text[i] for i in O.kept_readings(page)] == want


def test_pieces_and_numbers():
    assert O.joined_text("NIV3 PA", "V3 PART 3") == "NIV3 PART 3" and O.joined_text("abc", "xyz") is None
    got = O.joined_pieces([reading("NIV3 PA", 0.9, 0, 0, 70, 10, True), reading("V3 PART 3", 0.8, 30, 1, 120, 11, True)])
    assert [(g["text"], g["cut"], g["score"], g["x1"], g["y1"]) for g in got] == [("NIV3 PART 3", False, 0.8, 120, 11)]
    assert O.count_numbers("ETRI: 11 10M 10MT16X24 @6", "ETRI: 14 10M 10MT16X24 @6") == (3, 1)


def test_digit_one():
    page = np.full((40, 30), 255, np.uint8)
    stem = page.copy()
    stem[4:36, 14:18] = 0
    one = stem.copy()
    one[6:10, 8:14] = 0
    arrow = one.copy()
    arrow[6:10, 18:24] = 0
    assert [O.looks_like_one(g) for g in (page, stem, one, arrow)] == [False, False, True, False]


def test_scores(spark):
    r = spark.createDataFrame([("a", 1, "A1", "4 25M"), ("a", 2, "A1", "12-06"), ("a", 3, "B2", "9 9"), ("a", 4, "A1", "7")], "file string, id long, cell string, text string")
    c = O.parse_corrections(spark.createDataFrame([("a", "reviewed: A1"), ("a", "# 3 = x"), ("a", "1 = 4 35M"), ("a", "4 ="), ("a", "missed A1: 12 20M"), ("a", "missed B2: 3")], "file string, value string"))
    got = {x.file: (x["read"], x.misread, x.undetected, x.not_text) for x in O.score_pages(r, c).collect()}
    assert got == {"a": (2, 1, 2, 1), None: (2, 1, 2, 1)}
    with pytest.raises(Exception, match="not understood"):
        O.parse_corrections(spark.createDataFrame([("a", "what?")], "file string, value string")).collect()
