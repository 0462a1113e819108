"""Greedy one-to-one matching, leaders and piles: folds of one page each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K


def box_gap(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Distance of two boxes, 0 where they overlap."""
    dx = F.greatest(bx0 - ax1, ax0 - bx1, F.lit(0.0))
    dy = F.greatest(by0 - ay1, ay0 - by1, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def _kinds(df: DataFrame, cols: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in cols)


def greedy(pairs: DataFrame, keys: list[str], a: str, b: str, order: list[str]) -> DataFrame:
    """Takes candidate pairs in ``order``; each ``a`` and each ``b`` once."""

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        left, right, keep = set(), set(), []
        page = page.sort_values([*order, a, b], kind="stable")
        for x, y in zip(page[a], page[b], strict=True):
            free = x not in left and y not in right
            keep.append(free)
            if free:
                left.add(x)
                right.add(y)
        return page.loc[keep, [*keys, a, b]]

    return pairs.groupBy(*keys).applyInPandas(fold, _kinds(pairs, [*keys, a, b]))


def match_nearest(columns: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Columns and tags without a leader, closest boxes first, within reach."""
    box = lambda p: [F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")]
    pairs = columns.select(*keys, "column_id", *[F.col(c).alias(f"c{c}") for c in ("x0", "y0", "x1", "y1")]).join(tags.select(*keys, "tag_id", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")]), keys)
    pairs = pairs.withColumn("far", box_gap(*box("c"), *box("t"))).filter(F.col("far") < K.PAIR_REACH)
    return greedy(pairs.select(*keys, "column_id", "tag_id", "far"), keys, "column_id", "tag_id", ["far"])


def pair_callouts(callouts: DataFrame, groups: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Callouts with groups of labels of the same direction: agreeing counts first, then the nearest.

    ``callouts(callout_id, x, y, lettered, quantity, band)``, ``groups(group_id, x, y, lettered,
    quantities, band)``. Agreeing: both counts, the quantity being one that the group may stand for.
    """
    g = groups.select(*keys, "group_id", F.col("x").alias("gx"), F.col("y").alias("gy"), "lettered", "quantities", F.col("band").alias("gband"))
    dx, dy = F.col("x") - F.col("gx"), F.col("y") - F.col("gy")
    pairs = callouts.join(g, [*keys, "lettered"]).withColumn("far", F.sqrt(dx * dx + dy * dy)).filter(F.col("far") <= reach)
    pairs = pairs.withColumn("differs", ~(F.array_contains("quantities", F.col("quantity")) & (F.col("band") == F.col("gband"))))
    # one order says both phases: a pair that agrees is taken before any that does not
    return greedy(pairs.select(*keys, "callout_id", "group_id", "differs", "far"), keys, "callout_id", "group_id", ["differs", "far"])


def components_of(links: DataFrame, nodes: DataFrame, keys: list[str], node: str, a: str = "a", b: str = "b") -> DataFrame:
    """Each node with the smallest node of its page that links reach."""
    rows = nodes.select(*keys, F.col(node).alias("a"), F.col(node).alias("b")).unionByName(links.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")))

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        up: dict = {}

        def find(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for x, y in zip(page.a, page.b, strict=True):
            low, high = sorted((find(x), find(y)))
            up[high] = low
        out = pd.DataFrame({node: list(up), "component": [find(x) for x in list(up)]})
        for k in keys:
            out[k] = page[k].iloc[0]
        return out[[*keys, node, "component"]]

    return rows.groupBy(*keys).applyInPandas(fold, f"{_kinds(nodes, [*keys, node])}, component {nodes.schema[node].dataType.simpleString()}")


def touching(a: Callable[[str], Column], b: Callable[[str], Column], upright: Column) -> Column:
    """Two lines of one direction, one right under the other; ``a`` and ``b`` give a box's columns."""
    least = F.least(a("x1") - a("x0"), a("y1") - a("y0"), b("x1") - b("x0"), b("y1") - b("y0"))
    across = F.when(upright, F.least(F.abs(a("x0") - b("x1")), F.abs(b("x0") - a("x1")))).otherwise(F.least(F.abs(a("y0") - b("y1")), F.abs(b("y0") - a("y1"))))
    overlap = F.when(upright, F.least(a("y1"), b("y1")) - F.greatest(a("y0"), b("y0"))).otherwise(F.least(a("x1"), b("x1")) - F.greatest(a("x0"), b("x0")))
    return (across <= K.TOUCHING_HEIGHTS * least) & (overlap > 0)


def same_row(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Boxes that overlap sideways and share over half of the lower one's height."""
    shared = F.least(a("y1"), b("y1")) - F.greatest(a("y0"), b("y0"))
    return (a("x0") < b("x1")) & (b("x0") < a("x1")) & (shared > 0.5 * F.least(a("y1") - a("y0"), b("y1") - b("y0")))


def linked(boxes: DataFrame, keys: list[str], id_: str, predicate: Callable) -> DataFrame:
    """Pairs (a < b) of a page's boxes for which the predicate holds."""
    cols = ["x0", "y0", "x1", "y1"]
    one = boxes.select(*keys, F.col(id_).alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    two = boxes.select(*keys, F.col(id_).alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    of = lambda p: lambda c: F.col(f"{p}_{c}")
    return one.join(two, keys).filter((F.col("a") < F.col("b")) & predicate(of("a"), of("b"))).select(*keys, "a", "b")


def label_piles(labels: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Each band count with the nearest label of its direction, and that label's pile.

    ``labels(label_id, x0..y1, upright)``, ``bands(band_id, x0..y1, upright)``.
    """
    mid = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    l = labels.select(*keys, "upright", "label_id", mid("x0", "x1").alias("lx"), mid("y0", "y1").alias("ly"))  # noqa: E741
    b = bands.select(*keys, "upright", "band_id", mid("x0", "x1").alias("bx"), mid("y0", "y1").alias("by"), F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("h"))
    far = F.abs(F.col("lx") - F.col("bx")) + F.abs(F.col("ly") - F.col("by"))
    best = b.join(l, [*keys, "upright"]).groupBy(*keys, "band_id", "h").agg(F.min(F.struct(far.alias("far"), "label_id")).alias("m")).filter(F.col("m.far") < 5 * F.col("h"))
    best = best.select(*keys, "band_id", F.col("m.label_id").alias("label_id"))
    links = linked(labels.filter("upright"), keys, "label_id", lambda p, q: touching(p, q, F.lit(True))).unionByName(linked(labels.filter("not upright"), keys, "label_id", lambda p, q: touching(p, q, F.lit(False))))
    piles = components_of(links, labels, keys, "label_id")
    held = piles.groupBy(*keys, "component").agg(F.array_sort(F.collect_list("label_id")).alias("pile"))
    return best.join(piles, [*keys, "label_id"]).join(held, [*keys, "component"]).select(*keys, "band_id", "label_id", F.array_remove("pile", F.col("label_id")).alias("pile"))


def follow_leaders(columns: DataFrame, tags: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Columns with the tag their leader reaches: (keys, column_id, tag_id).

    From segment ends in a column, up to four hops along segments whose ends meet (in cells of 1.5
    points, neighbouring cells included); a cell is entered once. ``segments(seg_id, ax, ay, bx, by)``.
    All columns of a page walk over the same index of segment ends, so a page is one fold.
    """
    box = ["x0", "y0", "x1", "y1"]
    rows = columns.select(*keys, F.lit(0).alias("role"), F.col("column_id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in box])
    rows = rows.unionByName(tags.select(*keys, F.lit(1).alias("role"), F.col("tag_id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in box]))
    rows = rows.unionByName(segments.select(*keys, F.lit(2).alias("role"), F.col("seg_id").cast("long").alias("id"), *[F.col(c).cast("double").alias(b) for c, b in zip(("ax", "ay", "bx", "by"), box, strict=True)]))

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        part = {r: page[page.role == r] for r in (0, 1, 2)}
        tag, tag_id = part[1][box].to_numpy(), part[1].id.to_numpy()
        seg = part[2][box].to_numpy()
        ends = np.concatenate([seg, seg[:, [2, 3, 0, 1]]])  # here and at the other end
        ends = ends[np.hypot(ends[:, 0] - ends[:, 2], ends[:, 1] - ends[:, 3]) < K.LEADER_LENGTH]
        cells: dict[tuple, list] = {}
        for (kx, ky), far in zip(np.rint(ends[:, :2] / K.SNAP).astype(int).tolist(), ends[:, 2:].tolist(), strict=True):
            cells.setdefault((kx, ky), []).append(far)
        out = []
        for col in part[0].itertuples():
            inside = [(seg[:, i] >= col.x0 - 2) & (seg[:, i] < col.x1 + 2) & (seg[:, i + 1] >= col.y0 - 2) & (seg[:, i + 1] < col.y1 + 2) for i in (0, 2)]
            tips = np.concatenate([seg[inside[1] & ~inside[0], :2], seg[inside[0] & ~inside[1], 2:]])
            entered, best = set(), (np.inf, -1)
            for _ in range(K.LEADER_HOPS):
                if not len(tips) or not len(tag):
                    break
                dx = np.maximum(np.maximum(tag[None, :, 0] - tips[:, None, 0], tips[:, None, 0] - tag[None, :, 2]), 0)
                dy = np.maximum(np.maximum(tag[None, :, 1] - tips[:, None, 1], tips[:, None, 1] - tag[None, :, 3]), 0)
                far = np.hypot(dx, dy).min(0)
                best = min(best, min(zip(far.tolist(), tag_id.tolist(), strict=True)))
                around = {(x + i, y + j) for x, y in np.rint(tips / K.SNAP).astype(int).tolist() for i in (-1, 0, 1) for j in (-1, 0, 1)} - entered
                entered |= around
                tips = np.array([p for c in around for p in cells.get(c, ())]).reshape(-1, 2)
            if best[0] <= K.TAG_REACH:
                out.append((*page[keys].iloc[0], col.id, best[1]))
        return pd.DataFrame(out, columns=[*keys, "column_id", "tag_id"])

    found = rows.groupBy(*keys).applyInPandas(fold, f"{_kinds(rows, keys)}, column_id long, tag_id long")
    kinds = {"column_id": columns.schema["column_id"].dataType, "tag_id": tags.schema["tag_id"].dataType}
    return found.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
