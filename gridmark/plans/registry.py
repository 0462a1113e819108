"""Queries by name, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions import text as T
from ..operators import comparing, gridlines, layout, matching, ocr, pairing, reporting
from .views import V_BAR, V_CALLOUT, V_LINE, duck, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name; ``sql`` says the same for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = duck(sql)
        return f

    return add


def _bars(spark, d):
    return view(spark, d, V_BAR)


def _lines(spark, d):
    return view(spark, d, V_LINE)


def _callouts(spark, d):
    return view(spark, d, V_CALLOUT).select("txt").distinct()


# -- notation --


@query("""select p_partkey, regexp_replace(replace(upper(p_name), ',', '.'), '[^\\p{L}\\p{N}.]', '', 'g') as label,
  regexp_replace(replace(upper(p_brand), ',', '.'), '[^\\p{L}\\p{N}.]', '', 'g') as brand from part""")
def label_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", T.label_key("p_name").alias("label"), T.label_key("p_brand").alias("brand"))


@query("""select distinct ident, case when s in ('plan', 'atelier') then s when ident like '%\\_plan' escape '\\' then 'plan' when ident like '%\\_atelier' escape '\\' then 'atelier' else s end as source
  from (select feuillet || '_' || element || '_' || source as ident, case when element < 'M' then ' ' || upper(source) else '' end as s0, lower(trim(case when element < 'M' then ' ' || upper(source) else '' end)) as s from v_bar)""")
def source_resolve(spark, d):
    rows = _bars(spark, d).select(F.concat_ws("_", "feuillet", "element", "source").alias("ident"), F.when(F.col("element") < "M", F.concat(F.lit(" "), F.upper("source"))).otherwise("").alias("s"))
    return rows.select("ident", T.record_source("s", "ident").alias("source")).distinct()


_TITLE = """case o_orderkey % 8 when 0 then 'PLAN DES COLONNES - REZ-DE-CHAUSSÉE' when 1 then 'Colonnes niveau ' || cast(o_custkey % 30 as string) when 2 then 'NIV. ' || cast(o_custkey % 9 as string)
  when 3 then 'SOUS-SOL S' || cast(o_custkey % 4 as string) when 4 then 'NOTES GÉNÉRALES' when 5 then 'Toit   appentis ' || cast(o_custkey % 5 as string) when 6 then 'SS' || cast(o_custkey % 3 as string) else 'sous sol' end"""


@query(f"""with t as (select distinct {_TITLE} as title from orders), u as (select title, upper(strip_accents(title)) as p from t)
  select title, case when regexp_matches(p, '\\bRDC\\b|REZ.DE.CHAUSSEE') then 'RDC'
    when regexp_matches(p, '\\bSOUS.?SOL\\s*S?(\\d*)|\\bSS\\s*(\\d*)\\b') then 'SS' || coalesce(nullif(regexp_extract(p, '\\bSOUS.?SOL\\s*S?(\\d*)|\\bSS\\s*(\\d*)\\b', 1), ''), regexp_extract(p, '\\bSOUS.?SOL\\s*S?(\\d*)|\\bSS\\s*(\\d*)\\b', 2))
    when regexp_matches(p, '\\bNIV(?:EAU)?\\.?\\s*(\\d+)') then 'N' || regexp_extract(p, '\\bNIV(?:EAU)?\\.?\\s*(\\d+)', 1)
    when regexp_matches(p, '\\bTOIT\\b') then regexp_replace(regexp_extract(p, '\\bTOIT\\b.*'), '\\s+', ' ', 'g') end as storey from u""")
def level_key(spark, d):
    return table(spark, d, "orders").select(F.expr(_TITLE).alias("title")).distinct().select("title", T.storey_key("title").alias("storey"))


@query("""with s as (select distinct 'XX_COLONNE-NIV-' || cast(o_custkey % 20 as string) || case when o_orderkey % 2 = 0 then '@' || cast(o_custkey % 20 + 1 as string) else '' end as stem from orders
    union select 'XX_COLONNES Partie 1' union select 'XX-NIV-FDN@SS2' union select 'XX-NIV-SS1@RDC' union select 'XX_NIV RDC@2')
  select stem, case when regexp_matches(f, '^\\d+$') then 'N' || f when f like 'FDN%' or f like 'FOND%' then 'FDN' when f = 'RDC' then 'RDC' when f = 'SS1' then 'SS1' end as storey
  from (select stem, split_part(regexp_extract(regexp_replace(upper(stem), '[-_]+', ' ', 'g'), '\\bNIV\\w*\\.?\\s+(\\S+)', 1), '@', 1) as f from s)""")
def lift_key(spark, d):
    stems = table(spark, d, "orders").select(F.expr("'XX_COLONNE-NIV-' || cast(o_custkey % 20 as string) || case when o_orderkey % 2 = 0 then '@' || cast(o_custkey % 20 + 1 as string) else '' end").alias("stem"))
    more = spark.sql("select explode(array('XX_COLONNES Partie 1', 'XX-NIV-FDN@SS2', 'XX-NIV-SS1@RDC', 'XX_NIV RDC@2')) as stem")
    return stems.union(more).distinct().select("stem", T.lift_storey("stem").alias("storey"))


@query("""select distinct txt, regexp_extract(txt, '(\\d+)\\s*-\\s*((?:10|15|20|25|30|35|45|55)M)\\b', 2) as diametre, cast(regexp_extract(txt, '^(\\d+)\\s*-', 1) as int) as quantite
  from v_callout where regexp_matches(txt, '^(\\d+)\\s*-\\s*((?:10|15|20|25|30|35|45|55)M)\\b')""")
def parse_counted(spark, d):
    b = _callouts(spark, d).select("txt", F.explode(T.plan_bars("txt")).alias("b")).filter("b.quantite is not null")
    return b.select("txt", "b.diametre", "b.quantite")


@query("""select distinct txt, regexp_extract(txt, '^(\\d\\dM)@', 1) as diametre,
    round_even(case when txt like '%"%' or cast(regexp_extract(txt, '@(\\d+)', 1) as double) <= 24 then cast(regexp_extract(txt, '@(\\d+)', 1) as double) * 25.4 else cast(regexp_extract(txt, '@(\\d+)', 1) as double) end, 0) as espacement_mm
  from v_callout where regexp_matches(txt, '^\\d\\dM@')""")
def parse_spaced(spark, d):
    b = _callouts(spark, d).select("txt", F.explode(T.plan_bars("txt")).alias("b")).filter("b.espacement_mm is not null")
    return b.select("txt", "b.diametre", "b.espacement_mm")


@query("""select distinct txt, cast(regexp_extract(txt, '^(\\d+)\\(', 1) as int) as haut, cast(regexp_extract(txt, '\\((\\d+)\\)', 1) as int) as bande, regexp_extract(txt, '-(\\d\\dM)', 1) as diametre
  from v_callout where regexp_matches(txt, '^\\d+\\(')""")
def parse_band(spark, d):
    p = T.whole(K.SLAB_CALLOUT)
    g = lambda i: F.regexp_extract("txt", p, i)
    b = _callouts(spark, d).filter(F.col("txt").rlike(p)).select("txt", T.slab_bars(g(1), g(2), F.concat(g(3), F.lit("M"))).alias("b"))
    return b.select("txt", F.col("b")[0]["quantite"].alias("haut"), F.col("b")[1]["quantite"].alias("bande"), F.col("b")[0]["diametre"].alias("diametre"))


@query("""select distinct v as value, round_even(case when v <= 24 then v * 25.4 else v end, 0) as bare, round_even(v * 25.4, 0) as inch, round_even(v, 0) as mm
  from (select cast(l_quantity as double) / 2 as v from lineitem)""")
def unit_convert(spark, d):
    v = table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") / 2).alias("value")).distinct()
    s = lambda u: T.spacing_mm(F.col("value"), F.lit(u))
    return v.select("value", s("").alias("bare"), s('"').alias("inch"), s("mm").alias("mm"))


@query("""select distinct t as title, array_to_string(list_transform(string_split(t, ','), lambda x: trim(replace(x, '/', '-'))), ';') as names from (select replace(element, '-', '/') || ', ' || element as t from v_bar
    where cast(split_part(element, '-', 2) as int) < 100)
  union all select distinct replace(element, '-', '/') || ', ' || element, '' from v_bar where cast(split_part(element, '-', 2) as int) >= 100""")
def name_split(spark, d):
    t = _bars(spark, d).select(F.concat(F.replace("element", F.lit("-"), F.lit("/")), F.lit(", "), F.col("element")).alias("title")).distinct()
    return t.select("title", F.array_join(T.detail_names("title"), ";").alias("names"))


@query("""select doc_id, length(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^0-9A-Z@/.\\-]', '', 'g')) as n_token, md5(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^0-9A-Z@/.\\-]', '', 'g')) as token_md5,
  md5(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^\\p{L}\\p{N}]', '', 'g')) as letters_md5 from documents""")
def token_norm(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.length(T.token_key("text")).cast("long").alias("n_token"), F.md5(T.token_key("text")).alias("token_md5"), F.md5(T.letters_key("text")).alias("letters_md5"))


@query("""select doc_id, cast(len(list_filter(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: regexp_matches(x, '[0-9]'))) as bigint) as n_numbers from documents""")
def digit_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.number_tokens("text")).cast("long").alias("n_numbers"))


@query("""select distinct mark, regexp_extract(mark, '^([A-ZÀ-Ý]{3,}\\d?)(\\s|$)', 1) as role, upper(diametre) as diametre, cast(regexp_replace(diametre, '\\D', '', 'g') as double) as size
  from (select case when repere is null then element else repere || ' ' || element end as mark, lower(diametre) as diametre from v_bar)""")
def role_extract(spark, d):
    b = _bars(spark, d).select(F.when(F.col("repere").isNull(), F.col("element")).otherwise(F.concat_ws(" ", "repere", "element")).alias("mark"), F.lower("diametre").alias("diametre")).distinct()
    return b.select("mark", T.bar_role("mark").alias("role"), T.diameter_key("diametre").alias("diametre"), T.diameter_size("diametre").alias("size"))


_FOLDER = "case doc_id % 6 when 0 then 'Semelles et radiers' when 1 then 'DA' when 2 then 'Refends' when 3 then 'Dalles' when 4 then 'COLONNES' else 'Autres' end"
_STEM = "source || case doc_id % 5 when 0 then '_POUTRES RDC' when 1 then '_CONCENTRATION COLONNES MUR' when 2 then '_NIV 22' when 3 then '_mur dalle' else '_NOTES' end"


@query(f"""select distinct folder, stem, case when regexp_matches(f, 'colon|fondation|semelle|radier|empattement|poutre|mur|refend|cisail|contrevent|dalle') then kind_f else kind_s end as kind from (
  select folder, stem, lower(strip_accents(folder)) as f,
   case when lower(folder) like 'semelles%' then 'fondation' when lower(folder) like 'refends%' then 'mur' when lower(folder) like 'dalles%' then 'dalle' when lower(folder) like 'colonnes%' then 'colonne' end as kind_f,
   case when stem like '%POUTRES%' then 'poutre' when stem like '%COLONNES%' then 'colonne' when stem like '%mur dalle' then 'mur' end as kind_s
  from (select {_FOLDER} as folder, {_STEM} as stem from documents))""")
def classify_by_word(spark, d):
    t = table(spark, d, "documents").select(F.expr(_FOLDER).alias("folder"), F.expr(_STEM).alias("stem")).distinct()
    return t.select("folder", "stem", T.kind_of_drawing("folder", "stem").alias("kind"))


# -- comparison and reports --


@query("""select source, feuillet, element, coalesce(repere, '') as role, diametre, round_even(espacement_mm, 1) as espacement_n, count(*) as n,
    case when count(quantite) = count(*) then cast(sum(quantite) as bigint) end as quantite, case when count(distinct longueur_mm) = 1 and count(longueur_mm) = count(*) then cast(min(longueur_mm) as bigint) end as longueur_mm
  from v_bar group by all""")
def bar_fuse(spark, d):
    out = comparing.fused(_bars(spark, d), ["source", "feuillet", "element"])
    return out.select("source", "feuillet", "element", "role", F.col("diametre_n").alias("diametre"), F.col("espacement_n").cast("double").alias("espacement_n"), "n", F.col("quantite").cast("long").alias("quantite"), F.col("longueur_mm").cast("long").alias("longueur_mm"))


def _cards(spark, d, per=("source", "feuillet", "type_element", "element", "diametre")):
    """A card for each source, label and diameter; ``ord`` follows the diameter."""
    bars = _bars(spark, d).withColumn("bar", T.bar(F.col("repere"), F.col("diametre"), F.col("quantite"), F.col("espacement_mm"), F.col("longueur_mm")))
    cards = bars.groupBy(*per).agg(F.array_sort(F.collect_list("bar")).alias("armature"))
    place = F.substring("diametre", 1, 2).cast("long") if "diametre" in per else F.lit(0).cast("long")
    return cards.select(place.alias("ord"), F.concat_ws("_", *[c for c in ("feuillet", "element", "source") if c]).alias("id"), "source", F.lit("f.pdf").alias("fichier"), "feuillet", F.lit(1).alias("page"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "type_element", "element", "armature")


@query("""with c as (select distinct source, feuillet, element, diametre from v_bar), r as (select *, row_number() over (partition by source, feuillet, element order by diametre) as rn from c),
  p as (select * from r where source = 'plan'), a as (select * from r where source = 'atelier')
  select coalesce(p.feuillet, a.feuillet) as feuillet, coalesce(p.element, a.element) as element, case when a.rn is null then 'manquant' when p.rn is null then 'ajoute' else 'paire' end as statut, count(*) as n
  from p full outer join a on p.feuillet = a.feuillet and p.element = a.element and p.rn = a.rn group by all""")
def pair_full_outer(spark, d):
    pairs = pairing.pair_records(_cards(spark, d))
    card = lambda c: F.coalesce(f"plan.{c}", f"atelier.{c}")
    return pairs.groupBy(card("feuillet").alias("feuillet"), card("element").alias("element"), "statut").agg(F.count(F.lit(1)).alias("n"))


@query()
def pair_mixed_types(spark, d):
    cards = _cards(spark, d)
    crossed = cards.withColumn("type_element", F.when(F.pmod(F.crc32(F.concat("id", F.col("ord").cast("string"))), 3) == 0, "mur").otherwise(F.col("type_element")))
    return pairing.pair_records(crossed).groupBy("statut").agg(F.count(F.lit(1)).alias("n"))


_COUNTED = """with b as (select source, feuillet, element, diametre, cast(sum(quantite) as bigint) as q from v_bar where espacement_mm is null group by all),
  p as (select * from b where source = 'plan'), a as (select * from b where source = 'atelier'),
  e as (select distinct source, feuillet, element from b), pe as (select * from e where source = 'plan'), ae as (select * from e where source = 'atelier'),
  j as (select coalesce(p.feuillet, a.feuillet) as feuillet, coalesce(p.element, a.element) as element, p.q is null or a.q is null or abs(p.q - a.q) > 0.05 as bad
        from p full outer join a on p.feuillet = a.feuillet and p.element = a.element and p.diametre = a.diametre),
  v as (select j.feuillet, j.element, case when bool_or(ae.element is null) then 'manquant' when bool_or(pe.element is null) then 'ajoute' when bool_or(bad) then 'non_conforme' else 'conforme' end as statut
        from j left join pe on j.feuillet = pe.feuillet and j.element = pe.element left join ae on j.feuillet = ae.feuillet and j.element = ae.element group by j.feuillet, j.element)"""


def _counted_verdicts(spark, d):
    """Verdicts on counted bars alone, without leaving the JVM: one aggregation, no join.

    Without roles and spacings an element complies where both sides have the same diameters and, of
    each, the same number. Both sides of a diameter meet in one group, those of an element in the next.
    """
    bars = _bars(spark, d).filter("espacement_mm is null")
    side = lambda s: F.col("source") == s
    lots = bars.groupBy("feuillet", "element", "type_element", T.diameter_key("diametre").alias("k")).agg(F.sum(F.when(side("plan"), F.col("quantite"))).alias("p"), F.sum(F.when(side("atelier"), F.col("quantite"))).alias("a"))
    same = F.coalesce(F.abs(F.col("p") - F.col("a")) <= K.TOLERANCE, F.lit(False))
    out = lots.groupBy("feuillet", "element").agg(F.min("type_element").alias("type_element"), F.bool_or(F.col("p").isNotNull()).alias("on_plan"), F.bool_or(F.col("a").isNotNull()).alias("in_shop"), F.bool_and(same).alias("same"))
    return out.withColumn("statut", F.when(~F.col("in_shop"), "manquant").when(~F.col("on_plan"), "ajoute").when(F.col("same"), "conforme").otherwise("non_conforme"))


@query(_COUNTED + " select feuillet, element, statut from v")
def verdict_counted(spark, d):
    return _counted_verdicts(spark, d).select("feuillet", "element", "statut")


@query(_COUNTED + """ select feuillet, count(*) as n, count(*) filter (statut = 'conforme') as conforme, count(*) filter (statut = 'non_conforme') as non_conforme, count(*) filter (statut = 'manquant') as manquant,
  count(*) filter (statut = 'ajoute') as ajoute, count(*) filter (statut <> 'conforme') as a_signaler, bool_and(statut = 'manquant') as sans_atelier from v group by feuillet""")
def report_by_sheet(spark, d):
    s = F.col("statut")
    v = _counted_verdicts(spark, d)
    return v.groupBy("feuillet").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(s == x).alias(x) for x in reporting.STATUSES], F.count_if(s != "conforme").alias("a_signaler"), F.bool_and(s == "manquant").alias("sans_atelier"))


def _judged(spark, d):
    return comparing.judged(pairing.pair_records(_cards(spark, d, ("source", "feuillet", "type_element", "element"))))


@query()
def verdict_full(spark, d):
    j = _judged(spark, d)
    card = lambda c: F.coalesce(f"plan.{c}", f"atelier.{c}")
    return j.select(card("feuillet").alias("feuillet"), card("element").alias("element"), "statut", F.size("barres").cast("long").alias("n_barres"), F.aggregate("barres", F.lit(0), lambda n, b: n + F.size(b["ecarts"])).cast("long").alias("n_ecarts"))


@query()
def report_rows(spark, d):
    return reporting.report_rows(_judged(spark, d))


@query()
def report_types(spark, d):
    return reporting.by_sheet(_judged(spark, d))


@query(_COUNTED + """ select feuillet, count(*) filter (statut = 'conforme') as conforme, count(*) filter (statut = 'non_conforme') as non_conforme, count(*) filter (statut = 'manquant') as manquant,
  count(*) filter (statut = 'ajoute') as ajoute, count(*) as total from v group by rollup (feuillet)""")
def status_crosstab(spark, d):
    return reporting.cross_tab(_counted_verdicts(spark, d), "feuillet", "statut", list(reporting.STATUSES))


@query("""with p as (select feuillet, element, array_agg(struct_pack(d := diametre, e := espacement_mm)) as bars from v_bar where source = 'plan' and repere is null group by all)
  select a.feuillet, a.element, a.diametre, a.espacement_mm, count(*) as n,
    case when a.espacement_mm is not null then len(list_filter(p.bars, lambda b: b.e is not null and b.d = a.diametre and a.espacement_mm < b.e)) > 0
         else len(list_filter(p.bars, lambda b: b.e is not null and b.d = a.diametre)) > 0 and len(list_filter(p.bars, lambda b: b.e is null and b.d = a.diametre)) = 0 end as detail
  from v_bar a join p on a.feuillet = p.feuillet and a.element = p.element where a.source = 'atelier' and a.repere is null group by all""")
def detail_bars(spark, d):
    b = _bars(spark, d).filter("repere is null").withColumn("bar", T.bar(F.col("repere"), F.col("diametre"), F.col("quantite"), F.col("espacement_mm"), F.col("longueur_mm")))
    plan = b.filter("source = 'plan'").groupBy("feuillet", "element").agg(F.collect_list("bar").alias("bars"))
    shop = b.filter("source = 'atelier'").join(plan, ["feuillet", "element"])
    out = shop.withColumn("detail", comparing.is_detail(F.col("bar"), F.col("bars"), F.lit(False)))
    return out.groupBy("feuillet", "element", "diametre", "espacement_mm", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("""with s as (select feuillet, element, bool_or(source = 'plan') as p, bool_or(source = 'atelier') as a from v_bar group by all)
  select feuillet, count(*) filter (p) as plan, count(*) filter (a) as atelier, count(*) filter (p and a) as paired, count(*) filter (p and not a) as plan_only, count(*) filter (a and not p) as atelier_only from s group by feuillet""")
def sheet_key_sets(spark, d):
    return reporting.name_sets(_bars(spark, d))


@query()
def sheet_key_sets_all(spark, d):
    """``sheet_key_sets`` over all bars, spaced ones too."""
    return reporting.name_sets(_bars(spark, d))


@query("""select id, min(ord) as ord, min_by(fichier, ord) as fichier, count(*) - 1 as repeats from (
    select feuillet || '_' || element || '_' || source as id, diametre || '.pdf' as fichier, cast(substr(diametre, 1, 2) as bigint) as ord from (select distinct source, feuillet, element, diametre from v_bar)) group by id""")
def first_wins(spark, d):
    cards = _cards(spark, d).withColumn("fichier", F.concat(F.col("ord").cast("string"), F.lit("M.pdf")))
    return pairing.first_of_each(cards).select("id", "ord", "fichier", (F.col("repeats_same") + F.col("repeats_different")).alias("repeats"))


@query("""select feuillet, case when rn > 1 then element || ' (' || cast(rn as string) || ')' else element end as element, ord from (
    select feuillet, element, ord, row_number() over (partition by feuillet, element order by ord) as rn from (select distinct feuillet, element, cast(substr(diametre, 1, 2) as bigint) as ord from v_bar where source = 'plan'))""")
def occurrence_suffix(spark, d):
    cards = _cards(spark, d).filter("source = 'plan'").select("feuillet", "element", "ord")
    return pairing.with_occurrence(cards, ("feuillet",), "element", ("ord",))


@query("""select feuillet, element, repere, diametre, espacement_mm, max(quantite) as quantite from v_bar where espacement_mm is not null or quantite > 0 group by all""")
def mats_distinct(spark, d):
    b = _bars(spark, d).filter("espacement_mm is not null or quantite > 0").withColumn("last", F.coalesce("quantite", F.lit(-1)))
    out = reporting.mats(b.select("feuillet", "element", "repere", "diametre", "espacement_mm", "quantite", "last"), ["feuillet", "element"], "last")
    return out


@query("""with t as (select p_partkey, p_size % 7 as lo, p_size % 7 + p_size % 5 as hi from part) select p_partkey, 'N' || cast(unnest(range(lo, hi + 1)) as string) as storey from t""")
def range_expand(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.expr("'ARMATURE DU NIVEAU ' || cast(p_size % 7 as string) || ' @ ' || cast(p_size % 7 + p_size % 5 as string)").alias("title"))
    return t.select("p_partkey", F.explode(reporting.expanded_range(F.col("title"))).alias("storey"))


# -- layout --

_SIGN = "with t as (select page, line_id, x, x1, y from v_line where kind = 'signup'), l as (select * from v_line where kind <> 'signup')"


def _titles(lines):
    return lines.filter("kind = 'signup'").select("page", F.col("line_id").alias("title_id"), F.col("x").alias("x0"), "x1", F.col("y").alias("y0"), (F.col("y") + 8).alias("y1"))


@query(_SIGN + """, s as (select *, case when y - lag(y) over (partition by page order by y, line_id) > 40 then 1 else 0 end as nw from t), r as (select *, sum(nw) over (partition by page order by y, line_id rows unbounded preceding) as row from s)
  select page, line_id as title_id, cast(row as int) as row, cast(row_number() over (partition by page, row order by x, line_id) as int) as place from r""")
def title_rows(spark, d):
    return layout.title_rows(_titles(_lines(spark, d)), ["page"], ties=("title_id",)).select("page", "title_id", "row", "place")


@query("""with m as (select page, x, x1, max(x1) over (partition by page order by x, x1 rows between unbounded preceding and 1 preceding) as reach from v_line where kind = 'view'),
  r as (select *, sum(case when x > reach + 6 then 1 else 0 end) over (partition by page order by x, x1 rows unbounded preceding) as run from m) select page, min(x) as x0, max(x1) as x1 from r group by page, run""")
def strokes_runs(spark, d):
    s = _lines(spark, d).filter("kind = 'view'").select("page", F.col("x").alias("x0"), "x1")
    return layout.covered_runs(s, ["page"])


@query(_SIGN + """, p as (select l.page, l.line_id, t.line_id as title_id, sqrt(pow(greatest(t.x - l.x, l.x - t.x1, 0.0), 2) + pow(t.y - l.y, 2)) as far from l join t on l.page = t.page and t.y > l.y)
  select page, line_id, arg_min(title_id, (far, title_id)) as title_id from p group by page, line_id""")
def nearest_title_under(spark, d):
    lines = _lines(spark, d)
    return layout.share_by_title_under(lines.filter("kind <> 'signup'"), _titles(lines), ["page"]).select("page", "line_id", "title_id")


@query(_SIGN + """, s as (select *, case when y - lag(y) over (partition by page order by y, line_id) > 40 then 1 else 0 end as nw from t), r as (select *, sum(nw) over (partition by page order by y, line_id rows unbounded preceding) as row from s),
  pl as (select page, row, line_id as title_id, (x + x1) / 2 as cx, row_number() over (partition by page, row order by x, line_id) as place from r), ry as (select page, row, min(y) as row_y from r group by page, row),
  own as (select l.page, l.line_id, l.x, arg_min(ry.row, ry.row_y) as row from l join ry on l.page = ry.page and ry.row_y > l.y group by l.page, l.line_id, l.x),
  pr as (select page, row, place, cx as lx, lead(cx) over (partition by page, row order by place) as rx from pl),
  pts as (select pr.page, pr.row, pr.place, own.x, pr.rx from own join pr on own.page = pr.page and own.row = pr.row where own.x > pr.lx and own.x < pr.rx union all select page, row, place, lx, rx from pr where rx is not null),
  g as (select *, coalesce(lead(x) over (partition by page, row, place order by x), rx) - x as gap from pts), b as (select page, row, place, max((gap, x)) as m from g group by page, row, place),
  lim as (select page, row, m[2] + m[1] / 2 as lim from b), q as (select own.page, own.row, own.line_id, 1 + count(*) filter (own.x > lim.lim) as place from own left join lim on own.page = lim.page and own.row = lim.row group by own.page, own.row, own.line_id)
  select q.page, q.line_id, pl.title_id from q join pl on q.page = pl.page and q.row = pl.row and q.place = pl.place""".replace("m[2]", "m.x").replace("m[1]", "m.gap").replace("max((gap, x))", "max(struct_pack(gap := gap, x := x))"))
def widest_gap_split(spark, d):
    lines = _lines(spark, d)
    return layout.share_by_title(lines.filter("kind <> 'signup'").select("page", "line_id", "x", "y"), _titles(lines), ["page"])


@query("""with lab as (select page, y, 'N' || cast(line_id % 9 as string) as storey from v_line where kind = 'signup'), l as (select page, line_id, y from v_line where kind = 'click')
  select l.page, l.line_id, coalesce(arg_min(lab.storey, (lab.y, lab.storey)), 'FDN') as storey from l left join lab on l.page = lab.page and lab.y > l.y group by l.page, l.line_id""")
def next_storey(spark, d):
    lines = _lines(spark, d)
    labels = lines.filter("kind = 'signup'").select("page", F.col("y").alias("label_y"), F.concat(F.lit("NIVEAU "), (F.col("line_id") % 9).cast("string")).alias("text"))
    return layout.storeys_under(lines.filter("kind = 'click'").select("page", "line_id", F.col("y").alias("y0")), labels, ["page"]).select("page", "line_id", "storey")


_GRID = """with v as (select cast(i * 12.5 as double) as position, cast(i + 1 as string) as label from range(0, 30) t(i)), h as (select cast(i * 60 as double) as position, chr(cast(65 + i as int)) as label from range(0, 20) t(i))"""


def _grid(spark):
    v = spark.range(30).select((F.col("id") * 12.5).alias("position"), (F.col("id") + 1).cast("string").alias("label"))
    h = spark.range(20).select((F.col("id") * 60.0).alias("position"), F.char(F.col("id") + 65).alias("label"))
    return v, h


def _on_pages(grid, lines):
    return grid.crossJoin(F.broadcast(lines.select("page").distinct()))  # a grid of fifty lines for each page


@query(_GRID + """, a as (select l.line_id, arg_min(v.label, (abs(v.position - l.x), v.position)) as vl from v_line l, v group by l.line_id), b as (select l.line_id, arg_min(h.label, (abs(h.position - l.y), h.position)) as hl from v_line l, h group by l.line_id)
  select a.line_id, hl || '-' || vl as crossing from a join b on a.line_id = b.line_id""")
def grid_crossing(spark, d):
    v, h = _grid(spark)
    lines = _lines(spark, d)
    return gridlines.crossings(lines, _on_pages(v, lines), _on_pages(h, lines), ["page"]).select("line_id", "crossing")


@query(_GRID + """, n as (select l.line_id, l.y, arg_min(h.label, (abs(h.position - l.y), h.position)) as near, min(abs(h.position - l.y)) as far, max(case when h.position < l.y then h.position end) as b, min(case when h.position > l.y then h.position end) as a
    from v_line l, h group by l.line_id, l.y), t as (select n.*, h.label as bl, cast(round_even(10 * (y - b) / nullif(a - b, 0), 0) as int) as tenths from n left join h on h.position = n.b)
  select line_id, case when far <= 20 then near when b is not null and a is not null and tenths between 1 and 9 then bl || '.' || cast(tenths as string) end as name,
    far > 20 and b is not null and a is not null and tenths between 1 and 9 as derived from t""")
def axis_name(spark, d):
    _, h = _grid(spark)
    lines = _lines(spark, d)
    return gridlines.axis_names(lines, _on_pages(h, lines), ["page"], "line_id", "y").select("line_id", "name", "derived")


@query(_GRID + """, s as (select position as a, position * 1.5 + 7 as b from h where cast(position / 60 as int) % 3 <> 1), g as (select a, b, lead(a) over (order by a) as c, lead(b) over (order by a) as e, row_number() over (order by a) = 1 as f from s),
  k as (select *, lead(c) over (order by a) is null as z from g where c is not null)
  select line_id, round(k.b + (l.y - a) * (e - k.b) / (c - a), 6) as mapped from v_line l join k on (f or l.y > a) and (z or l.y <= c)""")
def axis_map(spark, d):
    _, h = _grid(spark)
    lines = _lines(spark, d)
    part = h.filter((F.col("position") / 60).cast("int") % 3 != 1).select((F.col("position") * 1.5 + 7).alias("position"), "label")
    out = gridlines.axis_map(_on_pages(h, lines), _on_pages(part, lines), lines, ["page"], "line_id", "y")
    return out.select("line_id", F.round("mapped", 6).alias("mapped"))


@query("""with s as (select page, kind, x - lag(x) over (partition by page, kind order by x) as step from v_line) select page, coalesce(median(step), 100.0) as bay from s group by page""")
def grid_bay(spark, d):
    return gridlines.bay(_lines(spark, d).select("page", F.col("kind").alias("axis"), F.col("x").alias("position")), ["page"])


@query()
def ordered_run(spark, d):
    labels = _lines(spark, d).filter("kind = 'view'").select("page", F.col("y").alias("position"), (F.col("line_id") % 40 + 1).cast("string").alias("label"))
    return gridlines.ordered_runs(labels, ["page"])


@query("""select page, round_even(x, 0) as x, sum(y) as length from v_line group by page, round_even(x, 0) having sum(y) > 1500""")
def ruling_length(spark, d):
    from ..sources import drawings

    lines = _lines(spark, d)
    strokes = lines.select(F.lit("d").alias("doc"), "page", F.col("x").alias("ax"), F.lit(0.0).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    pages = lines.select(F.lit("d").alias("doc"), "page", F.lit(6000.0).alias("height")).distinct()
    out = drawings.rulings(strokes, pages).select("page", "x")
    total = lines.groupBy("page", F.bround("x", 0).alias("x")).agg(F.sum("y").alias("length"))
    return out.join(total, ["page", "x"])


@query("""with m as (select page, line_id, cast(round_even(y / 8, 0) as int) as band from v_line where kind in ('view', 'signup')), c as (select page, line_id, count(*) over (partition by page order by band range between 1 preceding and 1 following) as n from m)
  select page, line_id, n as in_row from c where n >= 3""")
def mark_rows(spark, d):
    m = _lines(spark, d).filter("kind in ('view', 'signup')").select("page", "line_id", F.col("y").alias("y0"))
    return layout.mark_rows(m, ["page"]).select("page", "line_id", "in_row")


@query("""with c as (select page, line_id, x, y from v_line where kind = 'view'), l as (select page, line_id, x, y from v_line where kind = 'signup'),
  n as (select l.page, l.line_id as letter_id, c.line_id as column_id, sqrt(pow(c.x - l.x, 2) + pow(c.y - l.y, 2)) as far, c.x > l.x as r, c.y > l.y as b from l join c on l.page = c.page where sqrt(pow(c.x - l.x, 2) + pow(c.y - l.y, 2)) <= 150),
  f as (select page, letter_id, arg_min(r, (far, column_id)) as r, arg_min(b, (far, column_id)) as b from n group by page, letter_id), v as (select page, r, b, count(*) as k, min(letter_id) as seen from f group by page, r, b),
  s as (select page, arg_max(r, (k, -seen)) as sr, arg_max(b, (k, -seen)) as sb from v group by page)
  select n.page, n.letter_id, arg_min(n.column_id, (not (n.r = s.sr and n.b = s.sb), n.far, n.column_id)) as column_id from n join s on n.page = s.page group by n.page, n.letter_id""")
def letter_side(spark, d):
    lines = _lines(spark, d)
    letters = lines.filter("kind = 'signup'").select("page", F.col("line_id").alias("letter_id"), "x", "y")
    columns = lines.filter("kind = 'view'").select("page", F.col("line_id").alias("column_id"), "x", "y")
    return layout.column_of_letter(letters, columns, ["page"])


def _boxes(spark, d, kinds="'view', 'signup'"):
    return _lines(spark, d).filter(f"kind in ({kinds})").select("page", "line_id", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", (F.col("y") + 8).alias("y1"))


@query("""with b as (select page, line_id, x, x1, y, y + 8 as y1 from v_line where kind in ('view', 'signup'))
  select p.page, p.line_id as a, q.line_id as b from b p join b q on p.page = q.page and p.line_id < q.line_id where p.x < q.x1 and q.x < p.x1 and least(p.y1, q.y1) - greatest(p.y, q.y) > 0.5 * least(p.y1 - p.y, q.y1 - q.y)""")
def same_row_links(spark, d):
    return matching.linked(_boxes(spark, d), ["page"], "line_id", matching.same_row)


@query("""with recursive b as (select page, line_id, x, x1, y, y + 8 as y1 from v_line where kind in ('view', 'signup')),
  e as (select p.page, p.line_id as a, q.line_id as b from b p join b q on p.page = q.page and p.line_id <> q.line_id where p.x < q.x1 and q.x < p.x1 and least(p.y1, q.y1) - greatest(p.y, q.y) > 4),
  c as (select page, line_id, line_id as root from b union select e.page, e.b, c.root from c join e on c.page = e.page and c.line_id = e.a)
  select page, line_id, min(root) as component from c group by page, line_id""")
def box_components(spark, d):
    boxes = _boxes(spark, d)
    return matching.components_of(matching.linked(boxes, ["page"], "line_id", matching.same_row), boxes, ["page"], "line_id")


@query()
def pile_components(spark, d):
    boxes = _boxes(spark, d, "'view', 'signup', 'click'").withColumn("upright", F.col("line_id") % 2 == 0)
    labels = boxes.withColumnRenamed("line_id", "label_id").filter("label_id % 3 <> 0")
    return matching.label_piles(labels, boxes.withColumnRenamed("line_id", "band_id").filter("band_id % 3 = 0"), ["page"])


@query()
def greedy_nearest(spark, d):
    lines = _lines(spark, d)
    box = [F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", (F.col("y") + 8).alias("y1")]
    return matching.match_nearest(lines.filter("kind = 'view'").select("page", F.col("line_id").alias("column_id"), *box), lines.filter("kind = 'click'").select("page", F.col("line_id").alias("tag_id"), *box), ["page"])


@query()
def greedy_two_phase(spark, d):
    lines = _lines(spark, d).withColumns({"lettered": F.col("line_id") % 2 == 0, "band": F.col("line_id") % 5})
    callouts = lines.filter("kind = 'view'").select("page", F.col("line_id").alias("callout_id"), "x", "y", "lettered", (F.col("line_id") % 7).alias("quantity"), "band")
    groups = lines.filter("kind = 'click'").select("page", F.col("line_id").alias("group_id"), "x", "y", "lettered", F.array(F.col("line_id") % 7, F.col("line_id") % 7 + 2).alias("quantities"), "band")
    return matching.pair_callouts(callouts, groups, ["page"], 120.0)


@query()
def leader_hops(spark, d):
    lines = _lines(spark, d)
    columns = lines.filter("kind = 'signup'").select("page", F.col("line_id").alias("column_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 12).alias("x1"), (F.col("y") + 12).alias("y1"))
    tags = lines.filter("kind = 'error'").select("page", F.col("line_id").alias("tag_id"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", (F.col("y") + 10).alias("y1"))
    segments = lines.filter("kind in ('view', 'click')").select("page", F.col("line_id").alias("seg_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + 30).alias("bx"), (F.col("y") + 25).alias("by"))
    return matching.follow_leaders(columns, tags, segments, ["page"])


@query()
def name_reconcile(spark, d):
    names = _bars(spark, d).select("source", "feuillet", "element").distinct()
    tenth = F.pmod(F.crc32(F.concat("feuillet", "element")), 8)
    dotted = F.concat(F.substring("element", 1, 1), F.lit("."), (tenth + 1).cast("string"), F.substring("element", 2, 9))
    plans = names.filter("source = 'plan'").select(F.crc32(F.concat("feuillet", "element")).alias("ord"), "feuillet", dotted.alias("element"), F.lit(True).alias("derived"))
    near = F.concat(F.substring("element", 1, 1), F.lit("."), (F.pmod(tenth + F.length("element"), F.lit(9)) + 1).cast("string"), F.substring("element", 2, 9))
    return pairing.reconcile_names(plans, names.filter("source = 'atelier'").select("feuillet", near.alias("element")))


@query()
def refile(spark, d):
    names = _bars(spark, d).select("source", "feuillet", "element").distinct()
    storeys = spark.sql("select stack(4, 'S-500', 'N1', 'S-501', 'N1', 'S-502', 'N2', 'S-503', 'N2') as (sheet, storey)")
    shops = names.filter("source = 'atelier'").select(F.crc32(F.concat("feuillet", "element")).alias("ord"), "feuillet", "element")
    return pairing.refile(shops, names.filter("source = 'plan'").select("feuillet", "element"), storeys)


def _word_overlap(spark, d, documents):
    docs = documents.select("doc_id", F.explode(F.array_distinct(T.title_words("text"))).alias("w"))
    items = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(T.title_words("text"))).alias("w"))
    return docs.join(items, "w").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query("""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(upper(replace(strip_accents(text), 'ß', 'SS')), '[A-Z]{4,}'))) as w from documents), b as (select item_id, unnest(list_distinct(regexp_extract_all(upper(replace(strip_accents(text), 'ß', 'SS')), '[A-Z]{4,}'))) as w from benchmark),
  w2 as (select distinct doc_id, rtrim(w, 'S') as w from w), b2 as (select distinct item_id, rtrim(w, 'S') as w from b)
  select doc_id, item_id, count(*) as shared from w2 join b2 on w2.w = b2.w group by doc_id, item_id""")
def word_overlap_rank(spark, d):
    return _word_overlap(spark, d, table(spark, d, "documents"))


@query()
def word_overlap_all(spark, d):
    """``word_overlap_rank`` over documents of every length."""
    return _word_overlap(spark, d, table(spark, d, "documents"))


# -- readings --


@query("""with b as (select page, line_id, x, x1, y, y + 8 as y1 from v_line where kind = 'view'), o as (select page, line_id, x, x1, y, y + 8 as y1 from v_line where kind = 'click')
  select b.page, b.line_id, round(coalesce(max(greatest(least(b.x1, o.x1) - greatest(b.x, o.x), 0) * greatest(least(b.y1, o.y1) - greatest(b.y, o.y), 0) / greatest((b.x1 - b.x) * (b.y1 - b.y), 1e-6)), 0), 9) as covered
  from b left join o on b.page = o.page group by b.page, b.line_id""")
def ocr_cover(spark, d):
    out = ocr.covered_share(_boxes(spark, d, "'view'"), _boxes(spark, d, "'click'").withColumnRenamed("line_id", "other_id"), ["page"], "line_id", "other_id")
    return out.select("page", "line_id", F.round("covered", 9).alias("covered"))


def _readings(spark, d):
    lines = _lines(spark, d)
    return lines.select("page", "line_id", ((F.col("line_id") % 100) / 100).alias("score"), (F.col("line_id") % 11 == 0).alias("cut"), F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", (F.col("y") + 8).alias("y1"), F.concat(F.lit("T"), (F.col("line_id") % 17).cast("string")).alias("text"), (F.col("line_id") % 5 == 0).alias("vertical"))


@query()
def ocr_dedupe(spark, d):
    return ocr.without_duplicates(_readings(spark, d), ["page"]).select("page", "line_id", "text")


@query("""with r as (select page, line_id, x, x1, y, y + 8 as y1, 'T' || cast(line_id % 17 as string) as text from v_line), w as (select * from r where line_id % 4 = 0), k as (select * from r where line_id % 4 = 1), o as (select * from r where line_id % 4 in (1, 2)),
  a as (select w.page, w.line_id, bool_or(k.x < w.x1 + 3 and k.x1 > w.x - 3 and k.y < w.y1 + 3 and k.y1 > w.y - 3 and contains(k.text, w.text)) as rd,
     bool_or((w.x + w.x1) / 2 >= k.x and (w.x + w.x1) / 2 < k.x1 and (w.y + w.y1) / 2 >= k.y and (w.y + w.y1) / 2 < k.y1) as ov from w join k on w.page = k.page group by w.page, w.line_id),
  b as (select w.page, w.line_id, bool_or(o.x < w.x1 + 3 and o.x1 > w.x - 3 and o.y < w.y1 + 3 and o.y1 > w.y - 3 and contains(o.text, w.text)) as rw from w join o on w.page = o.page group by w.page, w.line_id)
  select w.page, w.line_id as word_id, case when a.rd then 'read' when b.rw then 'duplicate' when a.ov then 'misread' else 'undetected' end as verdict
  from w left join a on w.page = a.page and w.line_id = a.line_id left join b on w.page = b.page and w.line_id = b.line_id""")
def ocr_verdict(spark, d):
    r = _readings(spark, d)
    words = r.filter("line_id % 4 = 0").withColumnRenamed("line_id", "word_id")
    return ocr.word_verdicts(words, r.filter("line_id % 4 = 1"), r.filter("line_id % 4 in (1, 2)"), ["page"]).select("page", "word_id", "verdict")


@query("""select line_id, chr(cast(65 + least(greatest(floor(x / 800 * 5), 0), 4) as int)) || cast(cast(least(greatest(floor(y / 1000 * 7), 0), 6) as int) + 1 as string) as cell from v_line""")
def cell_of(spark, d):
    at = ocr.cell_of(F.col("x"), F.col("y"), F.lit(800.0), F.lit(1000.0), F.lit(5), F.lit(7))
    return _lines(spark, d).select("line_id", at.alias("cell"))


@query("""with c as (select chr(cast(65 + least(greatest(floor(x / 800 * 5), 0), 4) as int)) || cast(cast(least(greatest(floor(y / 1000 * 7), 0), 6) as int) + 1 as string) as cell, line_id from v_line)
  select cell, min(line_id) as first_id, max(line_id) as last_id, count(*) as n from c group by cell""")
def cell_ranges(spark, d):
    at = ocr.cell_of(F.col("x"), F.col("y"), F.lit(800.0), F.lit(1000.0), F.lit(5), F.lit(7))
    return _lines(spark, d).select(at.alias("cell"), "line_id").groupBy("cell").agg(F.min("line_id").alias("first_id"), F.max("line_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query()
def ocr_score(spark, d):
    r = _readings(spark, d).select((F.col("page") % 3).cast("string").alias("file"), F.col("line_id").alias("id"), F.concat(F.lit("A"), (F.col("line_id") % 4).cast("string")).alias("cell"), F.concat("text", F.lit(" 25M 12-06")).alias("text"))
    lines = spark.sql("select stack(6, '0', 'reviewed: A1, A2', '0', '# note', '0', '5 = T5 25M 12-07', '1', 'reviewed: all', '1', 'missed A3: 12 20M', '2', 'missed A1: 3 15M') as (file, value)")
    return ocr.score_pages(r, ocr.parse_corrections(lines))


from . import reader_queries  # noqa: E402,F401  adds its queries
