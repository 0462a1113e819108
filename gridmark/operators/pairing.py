"""One-to-one pairing of plan and shop records, and the repair of names before it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.text import label_key
from .folds import fold_sorted

_KEY = ["feuillet_n", "element_n"]


def labelled(records: DataFrame) -> DataFrame:
    return records.withColumns({"feuillet_n": label_key("feuillet"), "element_n": label_key("element"), "type_n": label_key("type_element")})


def pair_records(records: DataFrame) -> DataFrame:
    """Full-outer pairing of ``records(ord, source, ...)`` on their labels.

    Each plan card takes the first unused shop card of its label in input order: of its own type
    where the label has any, else of any type. Labels in which all plan cards draw from one list
    (typed or not) are a full outer join on the place in it; only labels that mix both go through a
    fold of their few cards. ``ord`` tells the cards of a side and label apart. Records of an unknown
    side are left out.
    Returns statut (paire, manquant, ajoute), the label and both records as nullable structs.
    """
    own = [c for c in records.columns]
    rows = labelled(records).withColumn("card", F.struct(*own))
    plans, shops = (rows.filter(F.col("source") == s) for s in ("plan", "atelier"))
    types = shops.select(*_KEY, "type_n").distinct().withColumn("same", F.lit(True))
    plans = plans.join(types, [*_KEY, "type_n"], "left").withColumn("typed", F.coalesce("same", F.lit(False)) & (F.col("type_n") != ""))
    # a label without shop cards is of either kind
    modes = plans.groupBy(*_KEY).agg(F.when(F.bool_and("typed"), "typed").when(~F.bool_or("typed"), "any").otherwise("mixed").alias("mode"))
    plans, shops = (x.join(modes, _KEY, "left").withColumn("mode", F.coalesce("mode", F.lit("any"))) for x in (plans, shops))
    pool = F.when(F.col("mode") == "typed", F.col("type_n")).otherwise("")

    def placed(x: DataFrame) -> DataFrame:
        x = x.filter("mode <> 'mixed'").withColumn("pool", pool)
        return x.withColumn("place", F.row_number().over(W.partitionBy(*_KEY, "pool").orderBy("ord"))).select(*_KEY, "pool", "place", "card")

    a, b = placed(plans).withColumnRenamed("card", "plan"), placed(shops).withColumnRenamed("card", "atelier")
    joined = a.join(b, [*_KEY, "pool", "place"], "full_outer").select(*_KEY, "plan", "atelier")
    mixed = rows.join(modes.filter("mode = 'mixed'").drop("mode"), _KEY, "left_semi").select(*_KEY, "type_n", "source", "ord")

    def fold(group: list[tuple]) -> list[tuple]:
        label, out, used = group[0][:2], [], set()
        free = [(kind, o) for _, _, kind, side, o in group if side == "atelier"]
        for _, _, kind, side, o in group:
            if side == "plan":
                wanted = [x for k, x in free if k == kind] if kind else []
                take = next((x for x in wanted or [x for _, x in free] if x not in used), None)
                used.add(take)
                out.append((*label, o, take))
        return out + [(*label, None, o) for _, o in free if o not in used]

    links = fold_sorted(mixed, _KEY, ["ord"], fold, "feuillet_n string, element_n string, p bigint, a bigint")
    cards = rows.join(modes.filter("mode = 'mixed'").drop("mode"), _KEY, "left_semi").select(*_KEY, "ord", "source", "card")
    links = links.join(cards.filter("source = 'plan'").select(*_KEY, F.col("ord").alias("p"), F.col("card").alias("plan")), [*_KEY, "p"], "left")
    links = links.join(cards.filter("source = 'atelier'").select(*_KEY, F.col("ord").alias("a"), F.col("card").alias("atelier")), [*_KEY, "a"], "left")
    out = joined.unionByName(links.select(*_KEY, "plan", "atelier"))
    return out.withColumn("statut", F.when(F.col("atelier").isNull(), "manquant").when(F.col("plan").isNull(), "ajoute").otherwise("paire"))


def first_of_each(records: DataFrame, key: str = "id", order: tuple[str, ...] = ("fichier", "page", "ord")) -> DataFrame:
    """The first record of each key, with how many later ones are the same and how many differ."""
    w = W.partitionBy(key).orderBy(*order)
    whole = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = records.withColumn("place", F.row_number().over(w)).withColumn("as_first", F.to_json("armature") == F.first(F.to_json("armature")).over(whole))
    out = out.withColumns({"repeats_same": F.count_if(F.col("as_first")).over(W.partitionBy(key)) - 1, "repeats_different": F.count_if(~F.col("as_first")).over(W.partitionBy(key))})
    return out.filter("place = 1").drop("place", "as_first")


def with_occurrence(records: DataFrame, keys: tuple[str, ...], name: str, order: tuple[str, ...]) -> DataFrame:
    """Later records of a name get their number behind it."""
    n = F.row_number().over(W.partitionBy(*keys, name).orderBy(*order))
    return records.withColumn("nth", n).withColumn(name, F.when(F.col("nth") > 1, F.concat(F.col(name), F.lit(" ("), F.col("nth"), F.lit(")"))).otherwise(F.col(name))).drop("nth")


def reconcile_names(plans: DataFrame, shops: DataFrame) -> DataFrame:
    """Plan columns named between grid lines take the only close name that the shop drawings use.

    ``plans(ord, feuillet, element, derived)``, ``shops(feuillet, element)``. Close: the same letter
    and number, both decimals within two tenths. A taken name is gone for later records, so each
    sheet is a small fold; sheets run side by side. Returns ord, feuillet, element, renamed.
    """
    both = plans.select("feuillet", "ord", "element", "derived", F.lit(True).alias("plan")).unionByName(
        shops.select("feuillet", F.lit(-1).cast("long").alias("ord"), "element", F.lit(False).alias("derived"), F.lit(False).alias("plan")).distinct()
    )
    parts = [F.regexp_extract("element", f"^(?:{K.DERIVED_NAME})$", i) for i in (1, 2, 3, 4)]
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(0))
    both = both.select("*", F.concat_ws("-", parts[0], parts[2]).alias("line"), (parts[0] != "").alias("named"), number(parts[1]).alias("tenth_a"), number(parts[3]).alias("tenth_b"))

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        shop = g[~g["plan"]]
        shop_names, taken = set(shop.element), set(g[g["plan"]].element)
        lines = {k: x for k, x in shop[shop.named].groupby("line")}
        rows = []
        for r in g[g["plan"]].sort_values("ord").itertuples():
            new = r.element
            if r.derived and r.named and r.element not in shop_names and r.line in lines:
                x = lines[r.line]
                near = x[((x.tenth_a - r.tenth_a).abs() <= K.CLOSE_TENTHS) & ((x.tenth_b - r.tenth_b).abs() <= K.CLOSE_TENTHS)]
                fits = [e for e in near.element if e not in taken]
                if len(fits) == 1:
                    new = fits[0]
                    taken.add(new)
            rows.append((r.ord, r.feuillet, new, new != r.element))
        return pd.DataFrame(rows, columns=["ord", "feuillet", "element", "renamed"])

    return both.groupBy("feuillet").applyInPandas(fold, "ord long, feuillet string, element string, renamed boolean")


def refile(shops: DataFrame, plans: DataFrame, storeys: DataFrame) -> DataFrame:
    """Shop records move to the sheet of the same storey whose plan has their element.

    ``shops(ord, feuillet, element)``, ``plans(feuillet, element)``, ``storeys(sheet, storey)``. Only
    where exactly one such sheet does not have the element on the shop side yet. An element of a
    storey is a small fold of its own. Returns ord, feuillet, element, moved.
    """
    of = storeys.select(F.col("sheet").alias("feuillet"), "storey").distinct()
    shop = shops.select("ord", "feuillet", "element", F.lit(False).alias("plan")).join(of, "feuillet", "left")
    plan = plans.select("feuillet", "element").distinct().join(of, "feuillet").select(F.lit(0).cast("long").alias("ord"), "feuillet", "element", F.lit(True).alias("plan"), "storey")
    known = shop.filter("storey is not null").unionByName(plan)

    def fold(g: list[tuple]) -> list[tuple]:
        plan_sheets = {sheet for _, sheet, _, plan, _ in g if plan}
        taken, rows = {sheet for _, sheet, _, plan, _ in g if not plan}, []
        for o, sheet, element, plan, _ in g:
            if not plan:
                homes = plan_sheets - taken - {sheet} if sheet not in plan_sheets else set()
                to = homes.pop() if len(homes) == 1 else sheet
                taken.add(to)
                rows.append((o, to, element, to != sheet))
        return rows

    known = known.select("ord", "feuillet", "element", "plan", "storey")
    out = fold_sorted(known, ["storey", "element"], ["ord"], fold, "ord bigint, feuillet string, element string, moved boolean")
    return out.unionByName(shop.filter("storey is null").select("ord", "feuillet", "element", F.lit(False).alias("moved")))
