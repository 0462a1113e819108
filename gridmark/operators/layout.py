"""Layout of a page: which lines, strokes and titles belong together.

All functions work on every page at once, partitioned by ``keys``; a page's lines are tens to
thousands. Intervals and nearest neighbours are joins within a page followed by a ranked choice; what
depends on the order of choices is a fold of one page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import plan_bars, storey_key


def centre(lo: str, hi: str) -> Column:
    return (F.col(lo) + F.col(hi)) / 2


def islands(df: DataFrame, keys: list[str], position: str, gap: float, name: str = "island", ties: tuple[str, ...] = ()) -> DataFrame:
    """Numbers groups whose neighbours along ``position`` are within ``gap`` (from 0, in order)."""
    w = W.partitionBy(*keys).orderBy(position, *ties)
    new = (F.col(position) - F.lag(position).over(w) > gap).cast("int")
    return df.withColumn("island_new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("island_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("island_new")


def title_rows(titles: DataFrame, keys: list[str], gap: float = K.TITLE_ROW_GAP, ties: tuple[str, ...] = ()) -> DataFrame:
    """Titles with their row of views (from 0, top to bottom) and place in it (from 1, left to right)."""
    out = islands(titles, keys, "y0", gap, "row", ties)
    return out.withColumn("place", F.row_number().over(W.partitionBy(*keys, "row").orderBy("x0", *ties)))


def covered_runs(strokes: DataFrame, keys: list[str], slack: float = 6) -> DataFrame:
    """Stretches (x0, x1) that strokes cover, those within ``slack`` of each other as one."""
    w = W.partitionBy(*keys).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.col("x0") > reach + slack).cast("int"), F.lit(0))
    out = strokes.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.groupBy(*keys, "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def next_below(points: DataFrame, marks: DataFrame, keys: list[str], point_id: str, y: str, mark_y: str, keep: list[str]) -> DataFrame:
    """Each point with the mark next below it (as-of join): one sorted pass over both, no pairs."""
    flag = F.lit(None).cast(points.schema[point_id].dataType)
    kinds = {c: marks.schema[c].dataType for c in keep}
    both = points.select(*keys, F.col(y).alias("at"), F.lit(1).alias("side"), F.col(point_id), *[F.lit(None).cast(kinds[c]).alias(c) for c in keep])
    both = both.unionByName(marks.select(*keys, F.col(mark_y).alias("at"), F.lit(0).alias("side"), flag.alias(point_id), *keep))
    # sorted downwards, marks after the points of the same height: only strictly lower ones count
    w = W.partitionBy(*keys).orderBy(F.col("at").desc(), F.col("side").desc(), *[F.col(c).desc() for c in keep]).rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("side") == 0, F.struct(F.col("at").alias("mark_at"), *keep)), ignorenulls=True).over(w)
    return both.withColumn("below", seen).filter("side = 1").select(*keys, point_id, F.col("at").alias(y), "below.*")


def row_of_lines(lines: DataFrame, titles: DataFrame, keys: list[str], line_id: str = "line_id") -> DataFrame:
    """Lines with the row of titles under them; lines below the last row are left out."""
    rows = title_rows(titles, keys, ties=("title_id",)).groupBy(*keys, "row").agg(F.min("y0").alias("row_y"))
    return next_below(lines, rows, keys, line_id, "y", "row_y", ["row"]).filter("row is not null")


def share_by_title(lines: DataFrame, titles: DataFrame, keys: list[str], line_id: str = "line_id") -> DataFrame:
    """Lines (x, y centres) with the title of their view: (keys, line_id, title_id).

    Views of a row are told apart at the widest stretch without lines between the centres of two
    neighbouring titles; of equal stretches the last one counts. Titles at the same place stand in order
    of ``title_id``.
    """
    placed = title_rows(titles, keys, ties=("title_id",)).withColumn("cx", centre("x0", "x1")).select(*keys, "row", "place", "title_id", "cx")
    own = row_of_lines(lines, titles, keys, line_id).join(lines.select(*keys, line_id, "x"), [*keys, line_id])
    w = W.partitionBy(*keys, "row").orderBy("place")
    pairs = placed.withColumn("right_x", F.lead("cx").over(w)).filter("right_x is not null").select(*keys, "row", "place", F.col("cx").alias("left_x"), "right_x")
    inside = own.join(pairs, [*keys, "row"]).filter((F.col("x") > F.col("left_x")) & (F.col("x") < F.col("right_x"))).select(*keys, "row", "place", "x", "right_x")
    points = inside.unionByName(pairs.select(*keys, "row", "place", F.col("left_x").alias("x"), "right_x"))
    step = F.coalesce(F.lead("x").over(W.partitionBy(*keys, "row", "place").orderBy("x")), F.col("right_x")) - F.col("x")
    best = points.withColumn("gap", step).groupBy(*keys, "row", "place").agg(F.max(F.struct("gap", "x")).alias("b"))
    limits = best.select(*keys, "row", (F.col("b.x") + F.col("b.gap") / 2).alias("limit"))
    passed = own.join(limits, [*keys, "row"], "left").groupBy(*keys, "row", line_id).agg((F.count_if(F.col("x") > F.col("limit")) + 1).cast("int").alias("place"))
    return passed.join(placed, [*keys, "row", "place"]).select(*keys, line_id, "title_id")


def share_by_title_under(lines: DataFrame, titles: DataFrame, keys: list[str], line_id: str = "line_id") -> DataFrame:
    """Lines with the nearest title below them, counting how far they are beyond its ends."""
    pairs = lines.select(*keys, line_id, "x", "y").join(titles.select(*keys, "title_id", F.col("x0").alias("tx0"), F.col("x1").alias("tx1"), F.col("y0").alias("ty")), keys).filter(F.col("ty") > F.col("y"))
    side = F.greatest(F.col("tx0") - F.col("x"), F.col("x") - F.col("tx1"), F.lit(0.0))
    pairs = pairs.withColumn("far", F.sqrt(side * side + (F.col("ty") - F.col("y")) * (F.col("ty") - F.col("y"))))
    return pairs.groupBy(*keys, line_id).agg(F.min(F.struct("far", "title_id")).alias("m")).select(*keys, line_id, F.col("m.title_id").alias("title_id"), F.col("m.far").alias("distance"))


def storeys_under(lines: DataFrame, labels: DataFrame, keys: list[str], line_id: str = "line_id") -> DataFrame:
    """Lines with the storey they stand on: the next label below, FDN below the last one."""
    marks = labels.withColumn("storey", storey_key("text")).filter("storey is not null")
    return next_below(lines, marks, keys, line_id, "y0", "label_y", ["storey"]).withColumn("storey", F.coalesce("storey", F.lit("FDN"))).drop("mark_at")


def stacked(lines: DataFrame, keys: list[str], gap: float = 1.3, indent: float = 8) -> DataFrame:
    """Lines written one under the other, left edges aligned, as blocks: adds ``block`` and ``place``.

    A line joins the block whose last line it is aligned with best, so each page is a fold.
    """

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", "x0"], kind="stable").reset_index(drop=True)
        ends: list[tuple[float, float, int]] = []  # x0 and y1 of a block's last line, its lines
        block, place = [], []
        for x0, y0, y1 in zip(page.x0, page.y0, page.y1, strict=True):
            h = y1 - y0
            fits = [(abs(bx - x0), i) for i, (bx, by, _) in enumerate(ends) if abs(bx - x0) <= indent and -0.5 * h <= y0 - by <= gap * h]
            i = min(fits)[1] if fits else len(ends)
            if i == len(ends):
                ends.append((x0, y1, 0))
            ends[i] = (x0, y1, ends[i][2] + 1)
            block.append(i)
            place.append(ends[i][2])
        return page.assign(block=block, place=place)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema) + ", block int, place int"
    return lines.groupBy(*keys).applyInPandas(fold, schema)


def span_titles(lines: DataFrame, title: str = K.SPAN_TITLE) -> DataFrame:
    """Titles of beam spans, with the name of the span: the first group of ``title``."""
    return lines.filter(F.col("text").rlike("^" + title)).withColumn("name", F.regexp_extract("text", "^" + title, 1))


def continuous_beams(titles: DataFrame, strokes: DataFrame, keys: list[str]) -> DataFrame:
    """Spans under one unbroken stretch of strokes as one beam: (keys, beam, spans), left to right."""
    rows = title_rows(titles, keys, ties=("title_id",))
    bands = rows.groupBy(*keys, "row").agg(F.min("y0").alias("bottom"), F.max("y1").alias("under"))
    bands = bands.withColumn("top", F.coalesce(F.lag("under").over(W.partitionBy(*keys).orderBy("row")), F.lit(0.0)))
    near = strokes.join(bands, keys).filter((F.col("y") >= F.col("top")) & (F.col("y") < F.col("bottom")))
    runs = covered_runs(near, [*keys, "row"]).withColumnsRenamed({"x0": "run_x0", "x1": "run_x1"})
    over = rows.withColumn("cx", centre("x0", "x1")).join(runs, [*keys, "row"], "left").filter(F.col("run_x0").isNull() | F.col("cx").between(F.col("run_x0"), F.col("run_x1")))
    held = over.groupBy(*keys, "row", "title_id").agg(F.min("run_x0").alias("run_x0"))
    whole = rows.join(held, [*keys, "row", "title_id"], "left")
    beam = F.coalesce(F.col("run_x0").cast("string"), F.concat(F.lit("title "), F.col("title_id").cast("string")))
    spans = F.array_sort(F.collect_list(F.struct("place", "title_id", "name")))
    out = whole.groupBy(*keys, "row", beam.alias("beam")).agg(spans.alias("s"))
    return out.select(*keys, "row", F.transform("s", lambda x: x["title_id"]).alias("spans"), F.array_join(F.transform("s", lambda x: x["name"]), "+").alias("name"))


def large_titles(lines: DataFrame, keys: list[str], pattern: str, share: float, usual: float | None = None) -> DataFrame:
    """Lines that match and are nearly as large as the largest match (and larger than usual text)."""
    w = W.partitionBy(*keys)
    hit = F.col("text").rlike(pattern)
    out = lines.withColumns({"largest": F.max(F.when(hit, F.col("size"))).over(w), "sizes": F.array_sort(F.collect_list("size").over(w))})
    keep = hit & (F.col("size") >= share * F.col("largest"))
    if usual is not None:
        keep &= F.col("size") >= usual * F.element_at("sizes", F.floor(F.size("sizes") / 2).cast("int") + 1)
    return out.filter(keep).drop("largest", "sizes")


def raft_titles(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Titles of raft views with the raft's number; notes that name a raft are written smaller."""
    return large_titles(lines, keys, K.RAFT, 0.8, K.TITLE_HEIGHT).withColumn("raft", F.regexp_extract("text", K.RAFT, 1))


def wall_titles(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Elevation titles with the wall's name: of the title, of the letter beside it, else the rank."""
    titles = large_titles(lines, keys, "(?U)^" + K.WALL_TITLE, 0.9).withColumn("own", F.nullif(F.regexp_extract("text", "(?U)^" + K.WALL_TITLE, 1), F.lit("")))
    titles = titles.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.bround(F.col("y0") / 40, 0), "x0")))
    letters = lines.filter(F.col("text").rlike(r"^(?:[A-Z]\d?|\d{1,2})$")).select(*keys, F.col("text").alias("letter"), F.col("x1").alias("lx1"), F.col("y0").alias("ly0"), F.col("size").alias("lsize"))
    gap = F.col("x0") - F.col("lx1")
    near = titles.join(letters, keys).filter((F.col("lsize") > F.col("size")) & (gap > 0) & (gap < K.LETTER_REACH) & (F.abs(F.col("ly0") - F.col("y0")) < 3 * (F.col("y1") - F.col("y0"))))
    best = near.groupBy(*keys, "line_id").agg(F.min(F.struct(gap.alias("gap"), "letter")).alias("beside"))
    return titles.join(best, [*keys, "line_id"], "left").withColumn("wall", F.coalesce("own", "beside.letter", F.col("rank").cast("string"))).drop("own", "beside")


def schedule_cells(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The footing schedule: (keys, type, role, line_id, bars) of the cells under its two headers.

    A cell is as high as from its type's label to the next one, and within half the distance of the
    two headers' centres of its own header.
    """
    y, cx = centre("y0", "y1"), centre("x0", "x1")
    heads = lines.select("*", F.when(F.col("text").rlike("^" + K.HEADERS["LONG"]), "LONG").when(F.col("text").rlike("^" + K.HEADERS["TRAN"]), "TRAN").alias("role")).filter("role is not null")
    heads = heads.groupBy(*keys, "role").agg(F.min_by(F.struct(cx.alias("cx"), F.col("y0").alias("head_y")), "line_id").alias("h")).select(*keys, "role", "h.*")
    page = heads.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("cx").alias("left"), (F.abs(F.max("cx") - F.min("cx")) / 2).alias("reach"), F.min("head_y").alias("top")).filter("n = 2")
    label = f"^(?:{K.TYPE_ROW})$"
    rows = lines.filter(F.col("text").rlike(label)).join(page, keys).withColumn("drop", F.col("y0") - F.col("top")).filter((F.col("x1") < F.col("left")) & (F.col("drop") > 0) & (F.col("drop") < 40 * (F.col("y1") - F.col("y0"))))
    w = W.partitionBy(*keys).orderBy("y0")
    rows = rows.select(*keys, F.regexp_extract("text", label, 1).alias("type"), "y0", "y1", F.lead("y0").over(w).alias("next_y"))
    pitch = F.coalesce(F.min(F.col("next_y") - F.col("y0")).over(W.partitionBy(*keys)), F.first(2 * (F.col("y1") - F.col("y0"))).over(W.partitionBy(*keys).orderBy("y0")))
    rows = rows.withColumn("bottom", F.coalesce("next_y", F.col("y0") + pitch)).select(*keys, "type", F.col("y0").alias("row_y"), "bottom")
    cells = lines.select(*keys, "line_id", "text", y.alias("cy"), cx.alias("line_cx"), F.col("y0").alias("line_y")).join(rows, keys).filter((F.col("cy") >= F.col("row_y") - 2) & (F.col("cy") < F.col("bottom") - 2))
    cells = cells.join(heads.select(*keys, "role", "cx"), keys).join(page.select(*keys, "reach"), keys).filter(F.abs(F.col("line_cx") - F.col("cx")) < F.col("reach"))
    return cells.select(*keys, "type", "role", "line_id", "line_y", plan_bars("text", F.col("role")).alias("bars"))


def letter_side(letters: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, right, below): on which side of its letter most columns stand; the first seen on ties."""
    near = _near(letters, columns, keys)
    best = near.groupBy(*keys, "letter_id").agg(F.min_by(F.struct("right", "below"), F.struct("far", "column_id")).alias("s"))
    votes = best.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("n"), F.min("letter_id").alias("seen"))
    return votes.groupBy(*keys).agg(F.max_by("s", F.struct("n", -F.col("seen"))).alias("s")).select(*keys, F.col("s.right").alias("side_right"), F.col("s.below").alias("side_below"))


def _near(letters: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    pairs = letters.select(*keys, "letter_id", "x", "y").join(columns.select(*keys, "column_id", F.col("x").alias("cx"), F.col("y").alias("cy")), keys)
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    pairs = pairs.withColumns({"far": F.sqrt(dx * dx + dy * dy), "right": dx > 0, "below": dy > 0})
    return pairs.filter(F.col("far") <= K.COLUMN_REACH)


def column_of_letter(letters: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Each letter's column: the nearest on the usual side, else the nearest."""
    near = _near(letters, columns, keys).join(letter_side(letters, columns, keys), keys)
    other = ~((F.col("right") == F.col("side_right")) & (F.col("below") == F.col("side_below")))
    return near.groupBy(*keys, "letter_id").agg(F.min(F.struct(other.alias("other"), "far", "column_id")).alias("m")).select(*keys, "letter_id", "m.column_id")


def mark_rows(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Marks in rows of three and more (a row: this height band and its neighbours)."""
    band = F.bround(F.col("y0") / K.MARK_ROW_GAP, 0)
    out = marks.withColumn("band", band)
    w = W.partitionBy(*keys).orderBy("band").rangeBetween(-1, 1)
    return out.withColumn("in_row", F.count(F.lit(1)).over(w)).filter("in_row >= 3").drop("band")


def table_columns(marks: DataFrame, rulings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right, name): the rulings around each mark; of several marks the lowest names it."""
    at = marks.select(*keys, F.col("line_id"), F.col("text").alias("name"), (F.col("x0") + 1).alias("mx"), "y0")
    near = at.join(rulings.select(*keys, F.col("x").alias("rx")), keys).groupBy(*keys, "line_id", "name", "y0", "mx")
    around = near.agg(F.max(F.when(F.col("rx") <= F.col("mx"), F.col("rx"))).alias("left"), F.min(F.when(F.col("rx") > F.col("mx"), F.col("rx"))).alias("right")).filter("left is not null and right is not null")
    return around.groupBy(*keys, "left").agg(F.max_by(F.struct("right", "name"), F.struct("y0", "line_id")).alias("m")).select(*keys, "left", "m.*")
