"""Views that give the tables of the test data the shapes of drawings; the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

V_BAR = """
select case when l_linestatus = 'F' then 'plan' else 'atelier' end as source,
       'S-' || cast(500 + l_suppkey % 4 as string) as feuillet,
       case l_suppkey % 4 when 0 then 'colonne' when 1 then 'dalle' when 2 then 'fondation' else 'mur' end as type_element,
       chr(cast(65 + l_partkey % 26 as int)) || '-' || cast(1 + cast((l_partkey - l_partkey % 26) / 26 as bigint) as string) as element,
       case when l_suppkey % 4 = 2 then case l_linenumber % 2 when 0 then 'LONG' else 'TRAN' end end as repere,
       case l_suppkey % 3 when 0 then '15M' when 1 then '20M' else '25M' end as diametre,
       case when l_returnflag <> 'R' then cast(l_quantity as int) end as quantite,
       case when l_returnflag = 'R' then case l_linenumber % 3 when 0 then 152 when 1 then 203 else 305 end end as espacement_mm,
       case when l_linestatus = 'O' then 1000 + 10 * l_linenumber end as longueur_mm
from {lineitem}"""
V_LINE = """
select event_id as line_id, user_id as page, event_type as kind, value as x, cast(event_id % 1000 as double) as y, value + 40.0 as x1
from {events}"""
V_CALLOUT = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case l_linenumber % 3
         when 0 then cast(cast(l_quantity as int) as string) || '-' || case l_suppkey % 3 when 0 then '15M' when 1 then '20M' else '25M' end
         when 1 then case l_suppkey % 3 when 0 then '15M' when 1 then '20M' else '25M' end || '@' || cast(cast(l_quantity as int) as string) || case when l_quantity <= 24 then '"' else '' end || ' c/c'
         else cast(cast(l_quantity as int) as string) || '(' || cast(cast(floor(l_quantity / 2) as int) as string) || ')-' || case l_suppkey % 3 when 0 then '15M' when 1 then '20M' else '25M' end
       end as txt
from {lineitem}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A view over the tables that its SQL names in braces."""
    names = [n for n in ("lineitem", "events") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def duck(sql: str) -> str:
    """SQL for DuckDB with the views it names as common table expressions."""
    views = {"v_bar": V_BAR, "v_line": V_LINE, "v_callout": V_CALLOUT}
    used = [f"{n} as ({v.format(lineitem='lineitem', events='events')})" for n, v in views.items() if n in sql]
    body = sql.strip()
    if used and body.lower().startswith("with recursive "):
        return f"with recursive {', '.join(used)}, {body[15:]}"
    if used and body.lower().startswith("with "):
        return f"with {', '.join(used)}, {body[5:]}"
    return f"with {', '.join(used)} {body}" if used else body
