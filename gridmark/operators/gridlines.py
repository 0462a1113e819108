"""Grid lines: finding them, naming places after them, mapping one drawing onto another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as K
from .layout import islands


def label_order(label: Column) -> Column:
    """Sort key of grid labels: wing, number or letters, decimal."""
    wing = F.when(label.rlike(r"^\d.*[A-Za-z]$"), F.right(label, F.lit(1))).otherwise("")
    rest = F.when(wing != "", F.regexp_replace(label, "[A-Za-z]$", "")).otherwise(label)
    head, decimal = F.split_part(rest, F.lit("."), F.lit(1)), F.split_part(rest, F.lit("."), F.lit(2))
    number = F.when(head.rlike(r"^\d+$"), F.nullif(F.regexp_replace(head, r"\D", ""), F.lit("")).cast("int")).otherwise(F.length(head) * 100 + F.ascii(head))
    return F.struct(wing.alias("wing"), number.cast("int").alias("head"), F.coalesce(F.nullif(decimal, F.lit("")).cast("int"), F.lit(0)).alias("tenths"))


def is_lettered(label: Column) -> Column:
    return label.rlike(r"^\p{L}")


def nearest_line(points: DataFrame, lines: DataFrame, keys: list[str], point_id: str, at: str, out: str) -> DataFrame:
    """Each point with the label of the nearest grid line of an axis; the first one on ties."""
    pairs = points.select(*keys, point_id, F.col(at).alias("at_")).join(lines.select(*keys, "position", "label"), keys)
    best = pairs.groupBy(*keys, point_id).agg(F.min(F.struct(F.abs(F.col("position") - F.col("at_")).alias("far"), "position", "label")).alias("m"))
    return best.select(*keys, point_id, F.col("m.label").alias(out))


def crossings(points: DataFrame, vertical: DataFrame, horizontal: DataFrame, keys: list[str], point_id: str = "line_id") -> DataFrame:
    """The nearest crossing of two grid lines as a name, letter first."""
    a = nearest_line(points, vertical, keys, point_id, "x", "v")
    b = nearest_line(points, horizontal, keys, point_id, "y", "h")
    name = F.when(is_lettered(F.col("h")) & ~is_lettered(F.col("v")), F.concat_ws("-", "h", "v")).otherwise(F.concat_ws("-", "v", "h"))
    return a.join(b, [*keys, point_id]).select(*keys, point_id, name.alias("crossing"))


def axis_names(points: DataFrame, lines: DataFrame, keys: list[str], point_id: str, at: str) -> DataFrame:
    """Places along one axis: the line within reach, else tenths between two lines, else null.

    Tenths count from the line that comes first in the order of labels, and only between whole lines.
    """
    pairs = points.select(*keys, point_id, F.col(at).alias("at_")).join(lines.select(*keys, "position", "label"), keys, "left")
    line = F.struct("position", "label")
    best = pairs.groupBy(*keys, point_id, "at_").agg(
        F.min(F.struct(F.abs(F.col("position") - F.col("at_")).alias("far"), "position", "label")).alias("near"),
        F.max(F.when(F.col("position") < F.col("at_"), line)).alias("before"), F.min(F.when(F.col("position") > F.col("at_"), line)).alias("after"),
    )
    swapped = label_order(F.col("after.label")) < label_order(F.col("before.label"))
    first, second = F.when(swapped, F.col("after")).otherwise(F.col("before")), F.when(swapped, F.col("before")).otherwise(F.col("after"))
    best = best.withColumns({"first": first, "second": second})
    ratio = F.try_divide(F.col("at_") - F.col("first.position"), F.col("second.position") - F.col("first.position"))
    tenths = F.bround(10 * ratio, 0).cast("int")
    between = F.col("before").isNotNull() & F.col("after").isNotNull() & ~F.contains(F.col("first.label"), F.lit(".")) & tenths.between(1, 9)
    on = F.col("near.far") <= K.ON_GRID
    name = F.when(on, F.col("near.label")).when(between, F.concat(F.col("first.label"), F.lit("."), tenths.cast("string")))
    return best.select(*keys, point_id, name.alias("name"), F.coalesce(~on & name.isNotNull(), F.lit(False)).alias("derived"))


def grid_names(points: DataFrame, vertical: DataFrame, horizontal: DataFrame, keys: list[str], point_id: str) -> DataFrame:
    """Two-axis names, letter first, and whether a part was worked out between lines."""
    a = axis_names(points, vertical, keys, point_id, "x").withColumnsRenamed({"name": "v", "derived": "dv"})
    b = axis_names(points, horizontal, keys, point_id, "y").withColumnsRenamed({"name": "h", "derived": "dh"})
    both = F.col("v").isNotNull() & F.col("h").isNotNull()
    name = F.when(is_lettered(F.col("h")) & ~is_lettered(F.col("v")), F.concat_ws("-", "h", "v")).otherwise(F.concat_ws("-", "v", "h"))
    return a.join(b, [*keys, point_id]).select(*keys, point_id, F.when(both, name).alias("name"), (both & (F.col("dv") | F.col("dh"))).alias("derived"))


def axis_map(source: DataFrame, target: DataFrame, points: DataFrame, keys: list[str], point_id: str, at: str) -> DataFrame:
    """Positions of one drawing on another through the lines both name; null with fewer than two.

    Linear between neighbouring shared lines, and beyond the last along the nearest pair.
    """
    goal = target.groupBy(*keys, "label").agg(F.max("position").alias("to"))
    shared = source.join(goal, [*keys, "label"]).select(*keys, F.col("position").alias("a"), F.col("to").alias("b"))
    w = W.partitionBy(*keys).orderBy("a", "b")
    legs = shared.withColumns({"c": F.lead("a").over(w), "d": F.lead("b").over(w), "first": F.row_number().over(w) == 1}).filter("c is not null")
    legs = legs.withColumn("last", F.lead("a").over(w).isNull())
    pairs = points.select(*keys, point_id, F.col(at).alias("at_")).join(legs, keys, "left")
    fits = F.col("a").isNull() | ((F.col("first") | (F.col("at_") > F.col("a"))) & (F.col("last") | (F.col("at_") <= F.col("c"))))
    to = F.col("b") + (F.col("at_") - F.col("a")) * F.try_divide(F.col("d") - F.col("b"), F.col("c") - F.col("a"))
    return pairs.filter(fits).select(*keys, point_id, to.alias("mapped"))


def bay(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The usual step between neighbouring grid lines, 100 where there are none. ``lines(axis, position)``."""
    step = F.col("position") - F.lag("position").over(W.partitionBy(*keys, "axis").orderBy("position"))
    return lines.withColumn("step", step).groupBy(*keys).agg(F.coalesce(F.median("step"), F.lit(100.0)).alias("bay"))


def _rank(label: str) -> tuple:
    wing = label[-1] if label[0].isdigit() and label[-1].isalpha() else ""
    head, _, tenth = (label[:-1] if wing else label).partition(".")
    return wing, int(head) if head.isdigit() else 100 * len(head) + ord(head[0]), int(tenth or 0)


def longest_run(found: list[tuple[float, str]]) -> list[tuple[float, str]]:
    """The longest run of labels in the order of grid lines, read either way; the first found on ties."""
    best: list[tuple[float, str]] = []
    for lettered in (True, False):
        line = sorted(x for x in found if x[1][0].isalpha() == lettered)
        for way in (line, line[::-1]):
            ranks, length, back = [_rank(t) for _, t in way], [1] * len(way), [-1] * len(way)
            for i in range(len(way)):
                for j in range(i):
                    if ranks[j] < ranks[i] and length[j] + 1 > length[i]:
                        length[i], back[i] = length[j] + 1, j
            if length and max(length) > len(best):
                i, best = length.index(max(length)), []
                while i >= 0:
                    best.append(way[i])
                    i = back[i]
    return sorted(best)


def ordered_runs(labels: DataFrame, keys: list[str]) -> DataFrame:
    """The longest ordered run of each group of ``labels(position, label)``."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        run = longest_run(list(zip(g.position.tolist(), g.label.tolist(), strict=True)))
        return pd.DataFrame([(*g[keys].iloc[0], p, t) for p, t in run], columns=[*keys, "position", "label"])

    kinds = ", ".join(f"{k} {labels.schema[k].dataType.simpleString()}" for k in keys)
    return labels.groupBy(*keys).applyInPandas(fold, f"{kinds}, position double, label string")


def shop_grid(words: DataFrame, keys: list[str]) -> DataFrame:
    """Grid lines (axis v or h, position, label) from the longest ordered rows of bubbles.

    A page has a grid where a row of bubbles and a column of the other kind hold three labels or more.
    """
    labels = words.filter(F.trim("text").rlike(f"^(?:{K.GRID_LABEL})$")).select(*keys, "x", "y", F.trim("text").alias("label"))
    runs = []
    for axis, across, along in (("v", "y", "x"), ("h", "x", "y")):
        groups = islands(labels, keys, across, K.SAME_ROW, "island", ("label", along))
        run = ordered_runs(groups.select(*keys, "island", F.col(along).alias("position"), "label"), [*keys, "island"])
        runs.append(run.withColumn("axis", F.lit(axis)))
    every = runs[0].unionByName(runs[1])
    size = every.groupBy(*keys, "axis", "island").agg(F.count(F.lit(1)).alias("n"), F.min_by(is_lettered(F.col("label")), "position").alias("lettered")).filter(F.col("n") >= K.SHORTEST_ROW)
    first = F.struct(-F.col("n"), F.col("island"))
    row = size.filter("axis = 'v'").groupBy(*keys).agg(F.min_by(F.struct("island", "lettered"), first).alias("r")).select(*keys, F.col("r.island").alias("island"), F.col("r.lettered").alias("kind"))
    col = size.filter("axis = 'h'").join(row.select(*keys, "kind"), keys).filter("lettered <> kind").groupBy(*keys).agg(F.min_by("island", first).alias("island"))
    row = row.join(col.select(*keys), keys, "left_semi")
    pick = row.select(*keys, F.lit("v").alias("axis"), "island").unionByName(col.select(*keys, F.lit("h").alias("axis"), "island"))
    return every.join(pick, [*keys, "axis", "island"], "left_semi").select(*keys, "axis", "position", "label")


def plan_grid(words: DataFrame, keys: list[str]) -> DataFrame:
    """Grid lines from the outermost rows and columns of short labels; a line's two bubbles are one.

    Rows of six labels and more count, of three where there are none. One axis is lettered, the other
    numbered; where both look alike, the one with more labels is believed.
    """
    labels = words.filter(F.col("text").rlike(f"^(?:{K.GRID_LABEL})$")).select(*keys, "x", "y", F.col("text").alias("label"))
    found = []
    for axis, across, along in (("v", "y", "x"), ("h", "x", "y")):
        g = islands(labels, keys, across, K.SAME_ROW, "island", (along, "label"))
        n = g.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n"))
        full = F.max("n").over(W.partitionBy(*keys)) >= 6
        n = n.withColumn("least", F.when(full, 6).otherwise(3)).filter("n >= least")
        ends = n.groupBy(*keys).agg(F.array_distinct(F.array(F.min("island"), F.max("island"))).alias("ends")).select(*keys, F.explode("ends").alias("island"))
        found.append(g.join(ends, [*keys, "island"]).select(*keys, F.lit(axis).alias("axis"), F.col(along).alias("position"), "label"))
    every = found[0].unionByName(found[1])
    n, letters = (F.count_if((F.col("axis") == a)) for a in "vh"), [F.count_if((F.col("axis") == a) & is_lettered(F.col("label"))) for a in "vh"]
    n = list(n)
    kind = every.groupBy(*keys).agg(n[0].alias("nv"), n[1].alias("nh"), (2 * letters[0] > n[0]).alias("lv"), (2 * letters[1] > n[1]).alias("lh"))
    alike, fuller = F.col("lv") == F.col("lh"), F.col("nv") >= F.col("nh")
    kind = kind.select(*keys, F.when(alike & ~fuller, ~F.col("lh")).otherwise(F.col("lv")).alias("lv"), F.when(alike & fuller, ~F.col("lv")).otherwise(F.col("lh")).alias("lh"))
    every = every.join(kind, keys).filter(is_lettered(F.col("label")) == F.when(F.col("axis") == "v", F.col("lv")).otherwise(F.col("lh")))
    # bubbles within 8 points of the line last kept are its other end
    rows = every.groupBy(*keys, "axis").agg(F.array_sort(F.collect_list(F.struct("position", "label"))).alias("s"))
    empty = F.array().cast("array<struct<position: double, label: string>>")
    kept = F.aggregate("s", empty, lambda out, x: F.when(F.coalesce(x["position"] - F.try_element_at(out, F.lit(-1))["position"] > 8, F.lit(True)), F.concat(out, F.array(x))).otherwise(out))
    return rows.select(*keys, "axis", F.explode(kept).alias("k")).select(*keys, "axis", "k.position", "k.label")
