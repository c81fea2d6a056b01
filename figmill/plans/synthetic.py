"""Records built from the star-schema tables, and the same rows as flat SQL for the oracles.

nation is a paper, customer a figure, orders a panel, lineitem with part a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIELDS_FIG = """
  c_custkey AS ord, CAST(n_nationkey AS STRING) AS paper_id, n_name AS title, r_name AS venue, 1992 + n_nationkey AS year,
  concat('Figure ', c_custkey) AS figure_id,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'bio' ELSE 'mlcs' END AS domain,
  CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE c_custkey % 10 WHEN 0 THEN 'schematic' WHEN 1 THEN 'analysis' WHEN 2 THEN 'qualitative_example' ELSE 'experiment' END AS figure_kind,
  CASE c_custkey % 4 WHEN 0 THEN concat('Figure ', c_custkey, '. Overview, n = ', c_custkey % 7 + 2, ' per group.') WHEN 1 THEN concat('Figure ', c_custkey, '. Data are mean ± SD.')
    WHEN 2 THEN concat('Figure ', c_custkey, '. Rates; * p < 0.05.') ELSE concat('Figure ', c_custkey, '. Plain.') END AS caption,
  c_custkey % 5 = 0 AS asks"""
FIELDS_PAN = """
  o_orderkey, o_custkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS panel_idx, concat('Experiment ', o_orderkey) AS experiment,
  o_orderpriority AS independent_var, o_orderstatus AS lvl,
  CASE o_orderstatus WHEN 'F' THEN 'not_reported' WHEN 'O' THEN 't-test' ELSE 'one-way ANOVA' END AS test,
  CASE o_orderkey % 5 WHEN 0 THEN 'mean ± SD' WHEN 1 THEN 'SEM' ELSE 'not_reported' END AS error_bar,
  CASE WHEN o_orderpriority LIKE '1%' THEN '3' ELSE 'not_reported' END AS replicates,
  CASE WHEN o_orderkey % 6 = 0 THEN '* p<0.05' ELSE 'N/A' END AS significance,
  CASE o_orderkey % 4 WHEN 0 THEN 'groups[].n' WHEN 1 THEN 'design.controlled' ELSE '' END AS inferred,
  CASE WHEN o_orderkey % 3 = 0 THEN 'groups[].readout' ELSE '' END AS ev_caption,
  CASE WHEN o_orderkey % 7 = 0 THEN 'stats.test' ELSE '' END AS ev_body,
  CASE WHEN o_orderkey % 2 = 1 THEN 'groups[].name' ELSE '' END AS ev_image"""
ORDER_GRP = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
FIELDS_GRP = f"""
  l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER_GRP}) - 1 AS group_idx, p_name AS name,
  CASE WHEN l_quantity = 50 THEN 'reference' WHEN l_returnflag = 'R' THEN 'treatment' WHEN l_returnflag = 'A' THEN 'control' WHEN l_linestatus = 'O' THEN 'baseline' ELSE 'ablation' END AS role,
  p_brand AS cond,
  CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN 'not_reported' WHEN 1 THEN 'not_reported（未涉及）' WHEN 2 THEN 'N/A' WHEN 3 THEN '-' WHEN 4 THEN '' WHEN 5 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS n,
  p_type AS readout, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING) AS result,
  CASE WHEN l_discount > 0.08 THEN '*** p<0.001' WHEN l_discount <= 0 THEN '基线' ELSE 'down' END AS vs"""

#: The label of a panel; Spark's ``char`` begins again at 256.
LABEL = "decode(unhex(lpad(hex(65 + panel_idx), 8, '0')), 'UTF-32')"

#: The same three tables for the oracles.
FLAT = f"""
fig AS (SELECT {FIELDS_FIG} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
pan AS (SELECT *, chr(CAST(65 + panel_idx AS INT)) AS label FROM (SELECT {FIELDS_PAN} FROM orders)),
grp AS (SELECT {FIELDS_GRP} FROM lineitem JOIN part ON l_partkey = p_partkey)"""
#: All groups with their panel and figure.
WIDE = FLAT + ",\nwide AS (SELECT * FROM fig JOIN pan USING (ord) JOIN grp ON l_orderkey = o_orderkey)"


def reported(x: str) -> str:
    """The missing-value test as SQL for the oracles."""
    t = f"lower(trim({x}))"
    return f"coalesce({t} <> '' AND NOT starts_with({t}, 'not_reported') AND {t} NOT IN ('n/a', 'na', '未说明', '-', '—', 'none', 'null'), false)"


def shown(x: str, default: str = "未说明") -> str:
    return f"CASE WHEN {reported(x)} THEN trim({x}) ELSE '{default}' END"


def load(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested records of all papers, with paper_id and ord."""
    t = load(spark, sf_dir, "region", "nation", "customer", "orders", "lineitem", "part")
    fig = spark.sql(f"SELECT {FIELDS_FIG} FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey", customer=t["customer"], nation=t["nation"], region=t["region"])
    pan = spark.sql(f"SELECT *, {LABEL} AS label FROM (SELECT {FIELDS_PAN} FROM {{orders}})", orders=t["orders"])
    grp = spark.sql(f"SELECT {FIELDS_GRP} FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey", lineitem=t["lineitem"], part=t["part"])
    one = "filter(array({}), x -> x <> '')"
    return spark.sql(
        f"""
        WITH g AS (SELECT l_orderkey, transform(array_sort(collect_list(struct(group_idx, struct(name, role, cond AS condition, n, readout, result, vs AS vs_control) AS g))), x -> x.g) AS groups FROM {{grp}} GROUP BY l_orderkey),
        p AS (SELECT ord, transform(array_sort(collect_list(struct(panel_idx, struct(label, experiment,
                struct(independent_var, array(lvl) AS levels, cast(array() AS array<string>) AS controlled, 'not_reported' AS unit) AS design,
                coalesce(groups, cast(array() AS array<struct<name:string,role:string,condition:string,n:string,readout:string,result:string,vs_control:string>>)) AS groups,
                struct(test, error_bar, replicates, significance) AS stats, 'not_reported' AS finding,
                struct({one.format("ev_caption")} AS from_caption, {one.format("ev_body")} AS from_body, cast(array() AS array<string>) AS from_methods, {one.format("ev_image")} AS from_image_only, {one.format("inferred")} AS inferred) AS evidence) AS p))), x -> x.p) AS panels
              FROM {{pan}} LEFT JOIN g ON l_orderkey = o_orderkey GROUP BY ord)
        SELECT paper_id, cast(f.ord AS bigint) AS ord, '1.0' AS schema_version, struct(title, cast(year AS int) AS year, venue, '' AS doi) AS paper, domain, figure_id, 'figure' AS kind, array(cast(f.ord % 50 + 1 AS int)) AS pages,
               array(concat('figures\\\\fig_', f.ord, '.png')) AS images, caption, figure_kind, 'not_reported' AS question,
               coalesce(panels, filter(collect_null, x -> false)) AS panels, 'not_reported' AS figure_conclusion, confidence, if(asks, array('?'), cast(array() AS array<string>)) AS open_questions
        FROM {{fig}} f LEFT JOIN p ON f.ord = p.ord
        """.replace("filter(collect_null, x -> false)", "cast(array() AS " + _panel_type() + ")"),
        fig=fig,
        pan=pan,
        grp=grp,
    )


def _panel_type() -> str:
    from figmill.schema import PANEL

    return f"array<{PANEL}>"


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of the events table, each about one figure."""
    t = load(spark, sf_dir, "events", "customer")
    return spark.sql(
        """
        SELECT cast(c_nationkey AS string) AS paper_id, event_id AS ord,
               concat(CASE event_type WHEN 'error' THEN '[致命] ' WHEN 'click' THEN '[复核] ' ELSE '[修复] ' END, 'file.json · Figure ', c_custkey, CASE WHEN event_id % 2 = 0 THEN ' panels[0](A)' ELSE '' END, ': note ', event_id % 5) AS warning
        FROM {events} JOIN {customer} ON c_custkey = 1 + user_id % (SELECT count(*) FROM {customer}) WHERE event_type IN ('error', 'click', 'signup')
        """,
        events=t["events"],
        customer=t["customer"],
    )


WARNINGS = """
warn AS (SELECT CAST(c_nationkey AS STRING) AS paper_id, event_id AS ord, c_custkey, event_type, event_id % 2 = 0 AS has_panel, 'note ' || (event_id % 5) AS body
         FROM events JOIN customer ON c_custkey = 1 + user_id % (SELECT count(*) FROM customer) WHERE event_type IN ('error', 'click', 'signup'))"""
