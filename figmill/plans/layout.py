"""Queries over layout primitives, with coordinates made from the star-schema numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from figmill.operators import layout
from figmill.plans.registry import query
from figmill.plans.synthetic import load

#: Papers of up to 100 orders, so that their number grows with the table and their pages do not.
_P = "CAST(o_orderkey DIV 100 AS STRING) AS paper_id, CAST(o_orderkey % 6 AS INT) AS pno"
_BY_CUSTOMER = "CAST(o_custkey % 40 AS STRING) AS paper_id, CAST(o_orderkey % 6 AS INT) AS pno"


def _sql(spark, sf, text: str, *names: str):
    return spark.sql(text, **load(spark, sf, *names))


def _rects(spark, sf):
    return _sql(spark, sf, f"SELECT {_P}, o_orderkey, o_custkey, CAST(o_custkey * 7 % 500 AS DOUBLE) AS x0, CAST(o_orderkey * 13 % 700 AS DOUBLE) AS y0, CAST(o_custkey * 7 % 500 + 10 + o_orderkey % 60 AS DOUBLE) AS x1, CAST(o_orderkey * 13 % 700 + 3 + o_orderkey % 40 AS DOUBLE) AS y1 FROM {{orders}}", "orders")


_RECTS = f"r AS (SELECT {_P.replace('STRING', 'VARCHAR').replace('DIV', '//')}, o_orderkey, o_custkey, CAST(o_custkey * 7 % 500 AS DOUBLE) AS x0, CAST(o_orderkey * 13 % 700 AS DOUBLE) AS y0, CAST(o_custkey * 7 % 500 + 10 + o_orderkey % 60 AS DOUBLE) AS x1, CAST(o_orderkey * 13 % 700 + 3 + o_orderkey % 40 AS DOUBLE) AS y1 FROM orders)"


def _pages(spark, sf):
    papers = _sql(spark, sf, "SELECT DISTINCT o_orderkey DIV 100 AS id FROM {orders}", "orders")
    return papers.select(F.col("id").cast("string").alias("paper_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pno"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))


_PAGES = "pages AS (SELECT CAST(a.range AS VARCHAR) AS paper_id, CAST(b.range AS INT) AS pno, 600.0::DOUBLE AS width, 800.0::DOUBLE AS height FROM (SELECT DISTINCT o_orderkey // 100 AS range FROM orders) a, range(6) b)"


@query("dedupe_rects", f"WITH {_RECTS} SELECT paper_id, pno, count(*) AS n, CAST(sum(x0 + y0) AS BIGINT) AS s FROM (SELECT DISTINCT paper_id, pno, x0, y0, x1, y1 FROM r WHERE x1 - x0 >= 20 AND y1 - y0 >= 20) GROUP BY ALL")
def dedupe_rects(spark, sf):
    return layout.dedupe_images(_rects(spark, sf)).groupBy("paper_id", "pno").agg(F.count("*").alias("n"), F.sum(F.col("x0") + F.col("y0")).cast("long").alias("s"))


@query("rule_vs_drawing", f"WITH {_RECTS} SELECT kind, count(*) AS n FROM (SELECT CASE WHEN y1 - y0 <= 3 AND x1 - x0 > 60 THEN 'rule' WHEN x1 - x0 >= 8 AND y1 - y0 >= 8 THEN 'graphic' END AS kind FROM r) WHERE kind IS NOT NULL GROUP BY kind")
def rule_vs_drawing(spark, sf):
    return layout.split_drawings(_rects(spark, sf), _pages(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


@query("page_stats", f"""WITH {_RECTS}, {_PAGES}, i AS (SELECT * FROM r WHERE o_custkey % 11 = 0), g AS (SELECT paper_id, pno, sum((x1 - x0) * (y1 - y0) / 2) AS drawn FROM r WHERE o_custkey % 11 <> 0 GROUP BY ALL), a AS (SELECT paper_id, pno, sum((x1 - x0) * (y1 - y0) * 40) AS raster, max((x1 - x0) * (y1 - y0) * 40) AS largest, count(*) AS n FROM i GROUP BY ALL),
    p AS (SELECT pages.*, pno * 200 AS n_chars, coalesce(raster, 0) AS raster, coalesce(largest, 0) AS largest, coalesce(n, 0) AS n, coalesce(drawn, 0) AS drawn FROM pages LEFT JOIN a USING (paper_id, pno) LEFT JOIN g USING (paper_id, pno))
    SELECT paper_id, pno, CASE WHEN largest / 480000 >= 0.1 AND n <= 4 THEN 'journal_raster' ELSE 'latex_vector' END AS route, (n_chars < 600 AND raster / 480000 > 0.1) OR raster / 480000 > 0.2 AS is_figure_page, largest >= 7200 OR drawn >= 7200 AS has_graphics FROM p""")
def page_stats(spark, sf):
    # each rectangle is an image or a drawing
    image, r = F.expr("o_custkey % 11 = 0"), _rects(spark, sf)
    images = r.filter(image).withColumn("x1", F.col("x0") + 40 * (F.col("x1") - F.col("x0")))
    facts = layout.page_facts(_pages(spark, sf).withColumn("n_chars", F.col("pno") * 200), images, r.filter(~image).withColumn("x1", (F.col("x0") + F.col("x1")) / 2))
    return facts.select("paper_id", "pno", "route", "is_figure_page", "has_graphics")


@query("selected_page_neighbor", f"WITH {_PAGES} SELECT paper_id, pno, lag(pno) OVER w AS before, lead(pno) OVER w AS after FROM pages WHERE (pno + CAST(paper_id AS INT)) % 3 <> 0 WINDOW w AS (PARTITION BY paper_id ORDER BY pno)")
def selected_page_neighbor(spark, sf):
    chosen = _pages(spark, sf).filter("(pno + cast(paper_id AS int)) % 3 <> 0")
    return layout.neighbours(chosen).select("paper_id", "pno", "before", "after")


_WORDS = "SELECT CAST(l_orderkey % 50 AS STRING) AS paper_id, CAST(l_partkey % 4 AS INT) AS pno, CAST(l_orderkey % 7 AS INT) AS block_no, CAST(l_linenumber AS INT) AS line_no, l_quantity * 10 AS x0, CAST(l_suppkey AS DOUBLE) AS y0, l_quantity * 10 + 8 AS x1, l_suppkey + 10.0 AS y1, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'w' END AS text FROM {lineitem}"


@query("line_rects", "SELECT CAST(l_orderkey % 50 AS VARCHAR) AS paper_id, CAST(l_partkey % 4 AS INT) AS pno, CAST(l_orderkey % 7 AS INT) AS block_no, CAST(l_linenumber AS INT) AS line_no, min(l_quantity) * 10 AS x0, CAST(min(l_suppkey) AS DOUBLE) AS y0, max(l_quantity) * 10 + 8 AS x1, max(l_suppkey) + 10.0::DOUBLE AS y1 FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL")
def line_rects(spark, sf):
    return layout.line_rects(_sql(spark, sf, _WORDS, "lineitem"))


@query("reading_order_lines", """WITH s AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS paper_id, CAST(o_orderkey % 6 AS INT) AS pno, CAST(o_orderkey % 2 AS INT) AS col, o_custkey AS block_no, string_agg('s' || o_orderkey, '' ORDER BY o_orderkey) AS text, CAST(min(o_orderkey * 13 % 700) AS DOUBLE) AS y0, CAST(min(o_custkey) AS DOUBLE) AS x0, bool_and(o_orderkey % 3 <> 0) AS emphatic FROM orders GROUP BY ALL)
    SELECT paper_id, pno, col, text, emphatic, CAST(row_number() OVER (PARTITION BY paper_id, pno ORDER BY col, y0, x0) AS INT) AS ord FROM s""")
def reading_order_lines(spark, sf):
    spans = _sql(spark, sf, f"SELECT {_BY_CUSTOMER}, CAST(o_orderkey % 2 AS INT) AS col, o_custkey AS block_no, 0 AS line_no, o_orderkey AS span_no, concat('s', o_orderkey) AS text, CAST(o_custkey AS DOUBLE) AS x0, CAST(o_orderkey * 13 % 700 AS DOUBLE) AS y0, 1.0D AS x1, 1.0D AS y1, 'Any' AS font, 9.04D AS size, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 16 END AS flags FROM {{orders}}", "orders")
    return layout.page_lines(spans).select("paper_id", "pno", "col", "text", "emphatic", "ord")


@query("body_size", """WITH w AS (SELECT CAST(p_size % 9 AS VARCHAR) AS paper_id, 8 + p_partkey % 4 * 0.5 AS size, sum(length(p_name)) AS chars, min(p_partkey) AS first FROM part GROUP BY ALL)
    SELECT paper_id, CAST(size AS DOUBLE) AS body, CAST(chars AS BIGINT) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chars DESC, first) AS k FROM w) WHERE k = 1""")
def body_size(spark, sf):
    lines = _sql(spark, sf, "SELECT CAST(p_size % 9 AS STRING) AS paper_id, 0 AS pno, p_partkey AS ord, CAST(8 + p_partkey % 4 * 0.5 AS DOUBLE) AS size, p_name AS text FROM {part}", "part")
    return layout.body_size(lines)


@query("doc_title", "SELECT CAST(n_nationkey AS VARCHAR) AS paper_id, 'On ' || n_name || ' and multi-part things' AS title FROM nation WHERE n_nationkey % 2 = 0")
def doc_title(spark, sf):
    n = load(spark, sf, "nation")["nation"]
    line = lambda k, t, size: F.struct(F.lit(k).alias("ord"), F.lit(float(k)).alias("y0"), F.lit(1.0).alias("x0"), t.alias("text"), size.alias("size"))
    large = F.when(F.col("n_nationkey") % 2 == 0, 16.0).otherwise(10.0)
    rows = F.array(line(0, F.lit("journal"), F.lit(8.0)), line(1, F.concat(F.lit("On "), "n_name", F.lit(" and")), large), line(2, F.lit("multi- part things"), large), line(3, F.repeat(F.lit("body "), F.lit(60)), F.lit(10.0)))
    lines = n.select(F.col("n_nationkey").cast("string").alias("paper_id"), F.lit(0).alias("pno"), F.explode(rows).alias("l")).select("paper_id", "pno", "l.*")
    return layout.doc_title(lines, layout.body_size(lines))


@query("column_edges", """WITH r AS (SELECT CAST(l_orderkey % 60 AS VARCHAR) AS paper_id, CASE WHEN l_quantity < 25 THEN 54.0 ELSE l_quantity + 40 END AS x0, 200.0 + l_quantity * 2 AS x1 FROM lineitem),
    b AS (SELECT paper_id, CAST(floor(x0 / 2) AS INT) AS bin, count(*) AS n, min(x0) AS lo FROM r GROUP BY ALL), m AS (SELECT paper_id, lo FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, bin) AS k FROM b) WHERE k = 1),
    a AS (SELECT r.*, lo FROM r JOIN m USING (paper_id) WHERE abs(x0 - lo) <= 4), k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY x1) - 1 AS i, count(*) OVER (PARTITION BY paper_id) AS n FROM a)
    SELECT paper_id, CAST(lo AS DOUBLE) AS "left", CAST(greatest(x1, lo + 40) AS DOUBLE) AS "right" FROM k WHERE i = floor(0.9 * (n - 1))""")
def column_edges(spark, sf):
    r = _sql(spark, sf, "SELECT CAST(l_orderkey % 60 AS STRING) AS paper_id, CASE WHEN l_quantity < 25 THEN 54.0D ELSE l_quantity + 40 END AS x0, 200.0D + l_quantity * 2 AS x1 FROM {lineitem}", "lineitem")
    return layout.column_edges(r, ["paper_id"])


@query("columns", """WITH r AS (SELECT CAST(l_orderkey % 60 AS VARCHAR) AS paper_id, CAST(l_partkey % 5 AS INT) AS pno, CASE WHEN l_orderkey % 60 < 30 AND l_suppkey % 2 = 0 THEN 320 ELSE 50 END AS x0 FROM lineitem)
    SELECT paper_id, pno, CASE WHEN CAST(any_value(paper_id) AS INT) < 30 AND count(*) FILTER (x0 = 50) >= 4 AND count(*) FILTER (x0 = 320) >= 4 THEN 2 ELSE 1 END AS columns FROM r GROUP BY paper_id, pno""")
def columns(spark, sf):
    r = _sql(spark, sf, "SELECT CAST(l_orderkey % 60 AS STRING) AS paper_id, CAST(l_partkey % 5 AS INT) AS pno, CASE WHEN l_orderkey % 60 < 30 AND l_suppkey % 2 = 0 THEN 320.0D ELSE 50.0D END AS x0 FROM {lineitem}", "lineitem")
    return layout.columns(r.withColumn("x1", F.col("x0") + 200), 600.0)


@query("running_bands", f"WITH {_PAGES} SELECT paper_id, pno, CASE WHEN CAST(paper_id AS INT) % 2 = 0 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS top, 770.0::DOUBLE AS bottom FROM pages")
def running_bands(spark, sf):
    p = _pages(spark, sf)
    head = F.when(F.col("paper_id").cast("int") % 2 == 0, F.lit("Journal of Things")).otherwise(F.concat(F.lit("Only "), F.element_at(F.split(F.lit("a b c d e f"), " "), F.col("pno") + 1)))
    block = lambda y0, y1, t: F.struct(F.lit(y0).alias("y0"), F.lit(y1).alias("y1"), t.alias("text"))
    rows = F.array(block(30.0, 50.0, head), block(300.0, 400.0, F.lit("Journal of Things")), block(770.0, 780.0, F.concat(F.lit("page "), F.col("pno").cast("string"))))
    return layout.running_bands(p.select("paper_id", "pno", F.explode(rows).alias("b")).select("paper_id", "pno", "b.*"), p)


@query("bold_runs", """WITH e AS (SELECT user_id % 50 AS paper, event_id, event_type IN ('click', 'view') AS f FROM events), c AS (SELECT *, CASE WHEN f AND lag(f) OVER w THEN 0 ELSE 1 END AS change FROM e WINDOW w AS (PARTITION BY paper ORDER BY event_id)),
    i AS (SELECT *, sum(change) OVER (PARTITION BY paper ORDER BY event_id) AS run FROM c) SELECT event_id AS ord, f AND count(*) FILTER (f) OVER (PARTITION BY paper, run) >= 3 AS bold_run FROM i""")
def bold_runs(spark, sf):
    lines = _sql(spark, sf, "SELECT CAST(user_id % 50 AS STRING) AS paper_id, 0 AS pno, event_id AS ord, 0 AS col, event_type IN ('click', 'view') AS emphatic, 500.0D AS x1, 500.0D AS col_x1, 300.0D AS col_w FROM {events}", "events")
    return layout.bold_runs(lines).select("ord", "bold_run")


@query("run_in", """SELECT event_id AS ord, event_type = 'click' AND coalesce((lead(event_type, 1) OVER w <> 'click' AND lead(y, 1) OVER w = y) OR (lead(event_type, 2) OVER w <> 'click' AND lead(y, 2) OVER w = y) OR (lead(event_type, 3) OVER w <> 'click' AND lead(y, 3) OVER w = y), false) AS runs_in
    FROM (SELECT *, event_id % 1000 // 4 AS y FROM events) WINDOW w AS (PARTITION BY user_id % 50 ORDER BY event_id)""")
def run_in(spark, sf):
    lines = _sql(spark, sf, "SELECT CAST(user_id % 50 AS STRING) AS paper_id, 0 AS pno, event_id AS ord, 0 AS col, event_type = 'click' AS emphatic, CAST(event_id % 1000 DIV 4 * 10 AS DOUBLE) AS y0, 100.0D AS x0, 90.0D AS x1 FROM {events}", "events")
    return layout.run_in(lines).select("ord", "runs_in")


@query("heading_groups", """SELECT CAST(c_nationkey AS VARCHAR) AS paper_id, CAST(c_custkey * 10 AS INT) AS ord, CASE c_custkey % 3 WHEN 0 THEN '3.1 Growth of ' || lower(c_mktsegment) ELSE 'Wrapped heading over two lines' END AS title FROM customer WHERE c_custkey % 3 <> 2""")
def heading_groups(spark, sf):
    c = load(spark, sf, "customer")["customer"]
    k = F.col("c_custkey") % 3
    line = lambda n, y, t, bold: F.struct((F.col("c_custkey") * 10 + n).cast("int").alias("ord"), (F.col("c_custkey") * 1000.0 + y).alias("y0"), (F.col("c_custkey") * 1000.0 + y + 12).alias("y1"), t.alias("text"), bold.alias("emphatic"))
    rows = F.array(
        line(0, 0.0, F.when(k == 0, F.concat(F.lit("3.1 Growth of "), F.lower("c_mktsegment"))).when(k == 1, "Wrapped heading over").otherwise("A. Author, B. Author, C. Author"), F.lit(True)),
        line(1, 14.0, F.when(k == 1, "two lines").otherwise("plain body text that ends."), k == 1),
        line(2, 40.0, F.lit("plain body text that ends."), F.lit(False)),
    )
    lines = c.select(F.col("c_nationkey").cast("string").alias("paper_id"), F.lit(0).alias("pno"), F.lit(0).alias("col"), F.lit(10.0).alias("size"), F.lit(False).alias("runs_in"), F.lit(False).alias("bold_run"), F.explode(rows).alias("l")).select("*", "l.*").drop("l")
    return layout.headings(lines, layout.body_size(lines)).select("paper_id", "ord", "title")


@query("section_levels", """SELECT CAST(c_nationkey AS VARCHAR) AS paper_id, seq, '§' || CASE WHEN seq % 3 = 0 THEN CAST(seq // 3 + 1 AS VARCHAR) ELSE (seq // 3 + 1) || '.' || (seq % 3) END AS id, CAST(CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END AS INT) AS level
    FROM (SELECT c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS seq FROM customer) WHERE n >= 6""")
def section_levels(spark, sf):
    heads = _sql(spark, sf, "SELECT *, CASE WHEN seq % 3 = 0 AND c_nationkey % 2 = 0 THEN concat(CAST(seq DIV 3 + 1 AS STRING), ' Part of it') ELSE 'Plain part' END AS title, CASE WHEN seq % 3 = 0 THEN 14.0D ELSE 12.0D END AS size FROM (SELECT CAST(c_nationkey AS STRING) AS paper_id, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS seq FROM {customer}) WHERE n >= 6", "customer")
    return layout.sections(heads).select("paper_id", "seq", "id", "level")


@query("section_mixed", """SELECT CAST(n_nationkey AS VARCHAR) AS paper_id, CAST(k AS INT) AS seq, (['§0.1', '§1', '§1.1', '§1.2', '§2.3', '§2.3.1', '§A', '§1#2'])[k] AS id FROM nation, range(1, 9) r(k)""")
def section_mixed(spark, sf):
    titles = ["Abstract", "1 Start", "Loose", "Looser", "2.3 Deep", "Loose", "A. Extra", "1 Start"]
    heads = load(spark, sf, "nation")["nation"].select(F.col("n_nationkey").cast("string").alias("paper_id"), F.posexplode(F.array(*map(F.lit, titles))).alias("seq", "title"))
    return layout.sections(heads.withColumn("seq", F.col("seq") + 1).withColumn("size", F.lit(12.0))).select("paper_id", "seq", "id")


@query("methods_propagation", """WITH s AS (SELECT CAST(p_size % 9 AS VARCHAR) AS paper_id, p_partkey AS seq, 1 + p_partkey % 3 AS level, p_partkey % 7 = 0 AS strong FROM part),
    b AS (SELECT a.paper_id, a.seq, max(s.seq) AS from_seq FROM s a JOIN s ON s.paper_id = a.paper_id AND s.strong AND s.seq <= a.seq AND (s.seq = a.seq OR NOT EXISTS (SELECT 1 FROM s m WHERE m.paper_id = a.paper_id AND m.seq > s.seq AND m.seq <= a.seq AND m.level <= s.level)) GROUP BY ALL)
    SELECT s.paper_id, s.seq, b.from_seq IS NOT NULL AS is_methods FROM s LEFT JOIN b USING (paper_id, seq)""")
def methods_propagation(spark, sf):
    secs = _sql(spark, sf, "SELECT CAST(p_size % 9 AS STRING) AS paper_id, p_partkey AS seq, 1 + p_partkey % 3 AS level, CASE WHEN p_partkey % 7 = 0 THEN 'Materials and Methods' ELSE 'Cells' END AS title FROM {part}", "part")
    return layout.mark_methods(secs).select("paper_id", "seq", "is_methods")


@query("paragraph_islands", """WITH e AS (SELECT user_id % 50 AS s, event_id, event_type = 'click' AS ind, lag(event_id) OVER (PARTITION BY user_id % 50 ORDER BY event_id) IS NULL AS first FROM events),
    p AS (SELECT s, sum(CASE WHEN first OR ind THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY event_id) AS part, event_id FROM e), g AS (SELECT s, part, string_agg('t' || event_id, ' ' ORDER BY event_id) AS text FROM p GROUP BY ALL)
    SELECT '§' || s || '¶' || row_number() OVER (PARTITION BY s ORDER BY part) AS id, text FROM g""")
def paragraph_islands(spark, sf):
    lines = _sql(spark, sf, "SELECT 'p' AS paper_id, concat('§', user_id % 50) AS section_id, 0 AS pno, event_id AS ord, 0 AS col, CASE WHEN event_type = 'click' THEN 70.0D ELSE 50.0D END AS x0, CAST(n * 12 AS DOUBLE) AS y0, 300.0D AS x1, CAST(n * 12 + 11 AS DOUBLE) AS y1, 300.0D AS col_x1, 250.0D AS col_w, concat('t', event_id) AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS n FROM {events})", "events")
    prev = lines.withColumn("x0", F.col("x0"))
    return layout.paragraphs(_indent_once(prev)).select("id", "text")


def _indent_once(lines):
    """Indents grow line by line, so each indented line begins a paragraph after any other."""
    from pyspark.sql import Window

    w = Window.partitionBy("section_id").orderBy("ord")
    return lines.withColumn("x0", 50.0 + 6.0 * F.sum((F.col("x0") > 60).cast("int")).over(w)).withColumn("x1", F.lit(1e6)).withColumn("col_x1", F.lit(1e6))


@query("vertical_clusters", f"""WITH {_RECTS}, c AS (SELECT *, max(y1) OVER (PARTITION BY paper_id, pno ORDER BY y0, x0, x1, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM r),
    g AS (SELECT *, sum(CASE WHEN y0 - low > 34 THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, pno ORDER BY y0, x0, x1, y1 ROWS UNBOUNDED PRECEDING) AS cluster FROM c)
    SELECT paper_id, pno, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY paper_id, pno, cluster""")
def vertical_clusters(spark, sf):
    return layout.clusters(_rects(spark, sf), ["paper_id", "pno"])


_ANCHORS = "a AS (SELECT paper_id, pno, o_orderkey AS anchor_id, 'figure' AS kind, x0, y0, x0 + 60 AS x1, y0 + 10 AS y1, CASE WHEN x0 < 300 THEN 0.0 ELSE 300.0 END AS c0 FROM r)"


def _anchors(spark, sf):
    r = _rects(spark, sf)
    c0 = F.when(F.col("x0") < 300, 0.0).otherwise(300.0)
    return r.select("paper_id", "pno", F.col("o_orderkey").alias("anchor_id"), F.lit("figure").alias("kind"), "x0", "y0", (F.col("x0") + 60).alias("x1"), (F.col("y0") + 10).alias("y1"), c0.alias("col_x0"), (c0 + 300).alias("col_x1"))


def _content(spark, sf):
    return _pages(spark, sf).withColumns({"content_x0": F.lit(0.0), "content_x1": F.lit(600.0), "content_top": F.lit(20.0), "content_bottom": F.lit(780.0)})


_OV = "greatest(0, least({b}.x1, {a}.c0 + 300) - greatest({b}.x0, {a}.c0)) > 0.3 * least({b}.x1 - {b}.x0, 300)".format(a="a", b="b")
_CEIL = f"cf AS (SELECT a.*, greatest(20.0, coalesce((SELECT max(b.y1) FROM a b WHERE b.paper_id = a.paper_id AND b.pno = a.pno AND b.anchor_id <> a.anchor_id AND {_OV} AND b.y1 <= a.y0 + 1), 20.0)) AS ceiling, least(780.0, coalesce((SELECT min(b.y0) FROM a b WHERE b.paper_id = a.paper_id AND b.pno = a.pno AND b.anchor_id <> a.anchor_id AND {_OV} AND b.y0 >= a.y1 - 1), 780.0)) AS floor FROM a)"


@query("ceiling_floor", f"WITH {_RECTS}, {_ANCHORS}, {_CEIL} SELECT anchor_id, CAST(ceiling AS DOUBLE) AS ceiling, CAST(floor AS DOUBLE) AS floor FROM cf")
def ceiling_floor(spark, sf):
    return layout.ceiling_floor(_anchors(spark, sf), _content(spark, sf)).select("anchor_id", "ceiling", "floor")


@query("caption_column", f"""WITH {_RECTS}, {_ANCHORS} SELECT anchor_id, CAST(CASE WHEN anchor_id % 2 = 0 THEN 0 WHEN x0 + 30 <= 291 THEN 20 WHEN x0 + 30 >= 309 AND x0 + 30 <= 576 THEN 315 ELSE 0 END AS DOUBLE) AS col_x0,
    CAST(CASE WHEN anchor_id % 2 = 0 THEN 600 WHEN x0 + 30 <= 291 THEN 285 WHEN x0 + 30 >= 309 AND x0 + 30 <= 576 THEN 570 ELSE 600 END AS DOUBLE) AS col_x1 FROM a""")
def caption_column(spark, sf):
    a = _anchors(spark, sf).drop("col_x0", "col_x1")
    a = a.withColumn("x1", F.when(F.col("anchor_id") % 2 == 0, F.col("x0") + 400).otherwise(F.col("x1")))
    cols = _pages(spark, sf).select("paper_id", "pno", F.posexplode(F.array(F.struct(F.lit(20.0).alias("c0"), F.lit(285.0).alias("c1")), F.struct(F.lit(315.0).alias("c0"), F.lit(570.0).alias("c1")))).alias("column_no", "c")).select("paper_id", "pno", "column_no", "c.*")
    return layout.caption_column(a, cols, _content(spark, sf)).select("anchor_id", "col_x0", "col_x1")


@query("graphics_bbox", f"""WITH {_RECTS}, {_ANCHORS}, {_CEIL}, g AS (SELECT * FROM r),
    c AS (SELECT cf.anchor_id, cf.c0, cf.y0 AS cap, cf.ceiling, g.x0, g.y0, g.x1, g.y1 FROM cf JOIN g ON g.paper_id = cf.paper_id AND g.pno = cf.pno AND g.y1 <= cf.y0 + 2 AND g.y1 > cf.ceiling + 2 AND greatest(0, least(g.x1, cf.c0 + 300) - greatest(g.x0, cf.c0)) > 0.25 * least(g.x1 - g.x0, 300)),
    b AS (SELECT anchor_id, greatest(min(x0), any_value(c0) - 12) AS x0, greatest(min(y0), any_value(ceiling)) AS y0, least(max(x1), any_value(c0) + 312) AS x1, least(max(y1), any_value(cap)) AS y1 FROM c GROUP BY anchor_id)
    SELECT anchor_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, 1.0::DOUBLE AS coverage FROM b WHERE x1 - x0 >= 24 AND y1 - y0 >= 24""")
def graphics_bbox(spark, sf):
    a = layout.ceiling_floor(_anchors(spark, sf), _content(spark, sf))
    r = _rects(spark, sf)
    return layout.graphics_bbox(a, r, r.limit(0)).select("anchor_id", "x0", "y0", "x1", "y1", "coverage")


@query("absorb_text", f"""WITH {_RECTS}, {_ANCHORS}, b AS (SELECT paper_id, pno, anchor_id, c0, y0 - 200 AS ceiling, y0 AS cap, c0 + 50.0 AS x0, y0 - 150 AS y0, c0 + 200.0 AS x1, y0 - 20 AS y1 FROM a), t AS (SELECT * FROM r),
    n AS (SELECT b.anchor_id, min(t.x0) AS a0, min(t.y0) AS b0, max(t.x1) AS a1, max(t.y1) AS b1 FROM b JOIN t ON t.paper_id = b.paper_id AND t.pno = b.pno AND t.y0 >= ceiling - 1 AND t.y1 <= cap + 1 AND least(t.x1, c0 + 300) > greatest(t.x0, c0)
      AND greatest(0, least(t.x1, b.x1 + 14) - greatest(t.x0, b.x0 - 14)) * greatest(0, least(t.y1, b.y1 + 14) - greatest(t.y0, b.y0 - 14)) > 0.6 * (t.x1 - t.x0) * (t.y1 - t.y0) GROUP BY b.anchor_id)
    SELECT anchor_id, CAST(greatest(least(x0, coalesce(a0, x0)), c0 - 12) AS DOUBLE) AS x0, CAST(greatest(least(y0, coalesce(b0, y0)), ceiling) AS DOUBLE) AS y0, CAST(least(greatest(x1, coalesce(a1, x1)), c0 + 312) AS DOUBLE) AS x1, CAST(least(greatest(y1, coalesce(b1, y1)), cap) AS DOUBLE) AS y1 FROM b LEFT JOIN n USING (anchor_id)""")
def absorb_text(spark, sf):
    a = _anchors(spark, sf)
    regions = a.select("paper_id", "pno", "anchor_id", "col_x0", "col_x1", (F.col("y0") - 200).alias("ceiling"), F.col("y0").alias("cap_y0"), (F.col("col_x0") + 50).alias("x0"), (F.col("y0") - 150).alias("y0"), (F.col("col_x0") + 200).alias("x1"), (F.col("y0") - 20).alias("y1"))
    return layout.absorb_text(regions, _rects(spark, sf)).select("anchor_id", "x0", "y0", "x1", "y1")


@query("finalize_bbox", f"""WITH {_RECTS}, {_ANCHORS} SELECT anchor_id, CAST(greatest(c0 + 46, 0) AS DOUBLE) AS x0, CAST(greatest(y0 - 104, y0 - 90, 20) AS DOUBLE) AS y0, CAST(least(c0 + 304, 600) AS DOUBLE) AS x1, CAST(least(y0, 780) AS DOUBLE) AS y1 FROM a""")
def finalize_bbox(spark, sf):
    a = _anchors(spark, sf)
    regions = a.select("paper_id", "pno", "anchor_id", "col_x0", "col_x1", (F.col("y0") - 90).alias("ceiling"), F.col("y0").alias("cap_y0"), (F.col("col_x0") + 50).alias("x0"), (F.col("y0") - 100).alias("y0"), (F.col("col_x0") + 300).alias("x1"), (F.col("y0") - 2).alias("y1"))
    return layout.finalize(regions, _content(spark, sf)).select("anchor_id", "x0", "y0", "x1", "y1")


@query("effective_column", f"""WITH {_RECTS}, {_ANCHORS}, g AS (SELECT * FROM r), w AS (SELECT a.anchor_id, min(g.x0) AS r0, max(g.x1) AS r1 FROM a JOIN g USING (paper_id, pno) WHERE g.y1 > 20 AND g.y1 <= a.y0 + 2 GROUP BY ALL),
    s AS (SELECT DISTINCT a.anchor_id FROM a JOIN a b USING (paper_id, pno) WHERE b.anchor_id <> a.anchor_id AND b.y0 > 20 AND NOT (b.x0 + 30 >= a.c0 AND b.x0 + 30 < a.c0 + 300))
    SELECT a.anchor_id, CAST(CASE WHEN o THEN 0 ELSE c0 END AS DOUBLE) AS col_x0, CAST(CASE WHEN o THEN 600 ELSE c0 + 300 END AS DOUBLE) AS col_x1 FROM (SELECT a.*, coalesce(r0 < c0 - 24 OR r1 > c0 + 324, false) AND s.anchor_id IS NULL AS o FROM a LEFT JOIN w USING (anchor_id) LEFT JOIN s USING (anchor_id)) a""")
def effective_column(spark, sf):
    a = _anchors(spark, sf).withColumn("ceiling", F.lit(20.0))
    return layout.effective_column(a, _rects(spark, sf), _content(spark, sf)).select("anchor_id", "col_x0", "col_x1")


@query("body_lines", f"""WITH {_RECTS}, {_ANCHORS}, z AS (SELECT paper_id, pno, anchor_id, c0, y0 - 200 AS g0, y0 AS g1 FROM a), t AS (SELECT *, row_number() OVER () AS tid FROM (SELECT paper_id, pno, x0, y0, x0 + 150 AS x1, y0 + 10 AS y1 FROM r)),
    i AS (SELECT z.*, t.tid, t.x0, t.x1, t.y0, t.y1 FROM z JOIN t USING (paper_id, pno) WHERE greatest(0, least(t.y1, g1) - greatest(t.y0, g0)) > 6 AND greatest(0, least(t.x1, c0 + 300) - greatest(t.x0, c0)) > 75),
    u AS (SELECT DISTINCT anchor_id, tid FROM i JOIN (SELECT paper_id, pno, x0 AS gx0, y0 AS gy0, x1 AS gx1, y1 AS gy1, o_orderkey FROM r) g USING (paper_id, pno) WHERE greatest(0, least(x1, gx1 + 200) - greatest(x0, gx0)) > 75 AND greatest(0, least(y1, gy1) - greatest(y0, gy0)) > 5)
    SELECT anchor_id, count(*) AS lines FROM i ANTI JOIN u USING (anchor_id, tid) GROUP BY anchor_id""")
def body_lines(spark, sf):
    r = _rects(spark, sf)
    a = _anchors(spark, sf)
    gaps = a.select("paper_id", "pno", "anchor_id", F.lit(0).alias("cluster"), F.col("col_x0").alias("x0"), (F.col("y0") - 200).alias("y0"), F.col("col_x1").alias("x1"), F.col("y0").alias("y1"), "col_x0", "col_x1")
    texts = r.select("paper_id", "pno", "x0", "y0", (F.col("x0") + 150).alias("x1"), (F.col("y0") + 10).alias("y1"))
    graphics = a.select("paper_id", "pno", "anchor_id").join(r.select("paper_id", "pno", "x0", "y0", (F.col("x1") + 200).alias("x1"), "y1"), ["paper_id", "pno"])
    return layout.body_lines(gaps, texts, graphics, ["paper_id", "pno", "anchor_id"]).select("anchor_id", "lines")


@query("caption_only", """WITH a AS (SELECT o_orderkey AS anchor_id, CAST(o_orderkey // 100 AS VARCHAR) AS paper_id, CAST(o_orderkey % 6 AS INT) AS pno, CAST(o_orderkey % 13 AS VARCHAR) AS number FROM orders), g AS (SELECT *, (pno + CAST(paper_id AS INT)) % 4 = 0 AS h FROM a)
    SELECT anchor_id FROM g WHERE NOT h AND (paper_id, number) IN (SELECT (paper_id, number) FROM g WHERE h)""")
def caption_only(spark, sf):
    a = _sql(spark, sf, f"SELECT {_P}, o_orderkey AS anchor_id, 'figure' AS kind, '' AS series, CAST(o_orderkey % 13 AS STRING) AS number FROM {{orders}}", "orders")
    facts = _pages(spark, sf).withColumn("has_graphics", (F.col("pno") + F.col("paper_id").cast("int")) % 4 == 0)
    return layout.caption_only(a, facts).select("anchor_id")


@query("number_order", "SELECT o_orderkey AS anchor_id, coalesce(o_orderkey % 6 < max(o_orderkey % 6) OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey % 97, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS out_of_order FROM orders")
def number_order(spark, sf):
    a = _sql(spark, sf, f"SELECT {_BY_CUSTOMER}, o_orderkey AS anchor_id, '' AS series, o_orderkey % 97 AS n FROM {{orders}}", "orders")
    return layout.number_order(a).select("anchor_id", "out_of_order")


@query("emit_assets", """WITH p AS (SELECT CAST(o_custkey % 40 AS VARCHAR) AS paper_id, CAST(o_custkey AS VARCHAR) AS number, CAST(o_orderkey % 6 AS INT) AS pno, o_orderkey, o_orderkey % 4 = 0 AS t, o_orderkey % 4 AS r, o_orderkey % 3 AS c FROM orders)
    SELECT paper_id, number, list_sort(list(DISTINCT pno))::VARCHAR AS pages, count(*) FILTER (NOT t) AS images, (['journal_raster', 'latex_vector', 'fallback_band', 'fallback_page'])[coalesce(max(r + 1) FILTER (NOT t), 4)] AS route, (['high', 'medium', 'low'])[coalesce(max(c + 1) FILTER (NOT t), 3)] AS trust,
    coalesce(arg_min('Figure part ' || o_orderkey || ' with its text', (pno, o_orderkey)) FILTER (o_orderkey % 5 <> 0), 'See next page for caption') AS lead, count(*) FILTER (o_orderkey % 5 <> 0) AS told FROM p GROUP BY ALL""")
def emit_assets(spark, sf):
    p = _sql(spark, sf, f"SELECT {_BY_CUSTOMER}, '' AS series, CAST(o_custkey AS STRING) AS number, CAST(o_orderkey AS DOUBLE) AS y0, o_orderkey % 4 = 0 AS text_only, CASE WHEN o_orderkey % 5 = 0 THEN 'See next page for caption' ELSE concat('Figure part ', o_orderkey, ' with its text') END AS caption, element_at(array('journal_raster', 'latex_vector', 'fallback_band', 'fallback_page'), CAST(o_orderkey % 4 + 1 AS INT)) AS route, element_at(array('high', 'medium', 'low'), CAST(o_orderkey % 3 + 1 AS INT)) AS trust FROM {{orders}}", "orders")
    a = layout.emit_assets(p)
    lead = F.regexp_extract("caption", "^(See next page for caption|Figure part \\d+ with its text)", 1)
    told = F.size(F.regexp_extract_all("caption", F.lit("Figure part"), F.lit(0)))
    return a.select("paper_id", "number", F.concat(F.lit("["), F.array_join(F.col("pages").cast("array<string>"), ", "), F.lit("]")).alias("pages"), F.size("images").cast("long").alias("images"), "route", "trust", lead.alias("lead"), told.cast("long").alias("told"))


@query("sort_assets", "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 2, CASE WHEN p_partkey % 3 = 0 THEN 999 ELSE p_size END, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE CAST(p_size AS VARCHAR) END, p_partkey) AS INT) AS place FROM part")
def sort_assets(spark, sf):
    p = _sql(spark, sf, "SELECT p_partkey, p_brand AS paper_id, CASE WHEN p_partkey % 2 = 1 THEN 'table' ELSE 'figure' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'A' ELSE CAST(p_size AS STRING) END AS number, p_partkey AS ord FROM {part}", "part")
    return layout.sort_assets(p).select("p_partkey", "place")


@query("table_side_vote", """WITH v AS (SELECT CAST(p_size AS VARCHAR) AS paper_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey % 5 END AS up, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 7 END AS down FROM part), w AS (SELECT paper_id, count(*) FILTER (up IS NOT NULL AND (down IS NULL OR up <= down)) AS above, count(*) FILTER (down IS NOT NULL AND (up IS NULL OR up > down)) AS below FROM v GROUP BY paper_id)
    SELECT paper_id, above, below, CASE WHEN above = 0 AND below = 0 THEN NULL WHEN above >= below THEN 'above' ELSE 'below' END AS side FROM w""")
def table_side_vote(spark, sf):
    g = _sql(spark, sf, "SELECT CAST(p_size AS STRING) AS paper_id, IF(p_partkey % 4 = 0, NULL, CAST(p_partkey % 5 AS DOUBLE)) AS up, IF(p_partkey % 3 = 0, NULL, CAST(p_partkey % 7 AS DOUBLE)) AS down FROM {part}", "part")
    return layout.side_vote(g)


@query("band_score", f"""WITH {_RECTS}, {_ANCHORS}, b AS (SELECT paper_id, pno, anchor_id AS band_id, c0, y1 AS b0, y1 + 200 AS b1 FROM a), l AS (SELECT b.band_id, count(*) AS rules FROM b JOIN (SELECT * FROM r) r USING (paper_id, pno) WHERE r.y0 >= b0 - 2 AND r.y0 + 1 <= b1 + 2 AND greatest(0, least(r.x0 + 200, c0 + 300) - greatest(r.x0, c0)) > 120 GROUP BY ALL),
    t AS (SELECT b.band_id, count(*) AS words, count(*) FILTER (o_orderkey % 2 = 0) AS numbers, count(DISTINCT round_even(y0 / 4, 0)) AS rows FROM b JOIN r USING (paper_id, pno) WHERE (r.y0 + r.y1) / 2 BETWEEN b0 - 1 AND b1 + 1 AND (r.x0 + r.x1) / 2 BETWEEN c0 - 12 AND c0 + 312 GROUP BY ALL)
    SELECT band_id, coalesce(rules, 0) AS rules, coalesce(words, 0) AS words, coalesce(numbers, 0) AS numbers, coalesce(rows, 0) AS rows, CAST(round(100 * (3.0 * coalesce(rules, 0) + CASE WHEN coalesce(words, 0) > 0 THEN 12.0 * numbers / words ELSE 0 END + 0.4 * least(coalesce(rows, 0), 25))) AS BIGINT) AS score FROM b LEFT JOIN l USING (band_id) LEFT JOIN t USING (band_id)""")
def band_score(spark, sf):
    r = _rects(spark, sf)
    bands = _anchors(spark, sf).select("paper_id", "pno", F.col("anchor_id").alias("band_id"), F.col("col_x0").alias("x0"), F.col("y1").alias("y0"), F.col("col_x1").alias("x1"), (F.col("y1") + 200).alias("y1"), "col_x0", "col_x1")
    rules = r.select("paper_id", "pno", "x0", "y0", (F.col("x0") + 200).alias("x1"), (F.col("y0") + 1).alias("y1"))
    words = r.withColumn("text", F.when(F.col("o_orderkey") % 2 == 0, "1.5%").otherwise("word"))
    return layout.band_score(bands, rules, words).select("band_id", "rules", "words", "numbers", "rows", F.round(F.col("score") * 100).cast("long").alias("score"))


def _cells(spark, sf):
    n = load(spark, sf, "nation")["nation"]
    return n.select(F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("row"), F.explode(F.array(*[F.struct((100.0 * k + (F.col("n_nationkey") % 3)).alias("x0"), (100.0 * k + 40 + (F.col("n_nationkey") % 3)).alias("x1"), F.concat(F.lit(f"c{k}-"), "n_nationkey").alias("text")) for k in range(3)])).alias("w")).select("table_id", "row", "w.*")


@query("words_to_grid", "SELECT n_regionkey AS table_id, n_nationkey AS row, 'c0-' || n_nationkey || '|c1-' || n_nationkey || '|c2-' || n_nationkey AS cells FROM nation")
def words_to_grid(spark, sf):
    w = _cells(spark, sf)
    boxes = w.groupBy("table_id").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return layout.text_grid(w, layout.column_bounds(w, boxes)).select("table_id", "row", F.array_join("cells", "|").alias("cells"))


@query("merge_tables", "SELECT CAST(p_size % 9 AS VARCHAR) AS paper_id, CAST(p_size AS VARCHAR) AS number, list_sort(list(DISTINCT p_partkey % 8))::VARCHAR AS pages, string_agg(p_name, '|' ORDER BY p_partkey) AS grid FROM part GROUP BY p_size")
def merge_tables(spark, sf):
    p = _sql(spark, sf, "SELECT CAST(p_size % 9 AS STRING) AS paper_id, CAST(p_size AS STRING) AS number, p_partkey AS ord, array(CAST(p_partkey % 8 AS INT)) AS pages, array(array(p_name)) AS grid FROM {part}", "part")
    m = layout.merge_tables(p)
    return m.select("paper_id", "number", F.concat(F.lit("["), F.array_join(F.col("pages").cast("array<string>"), ", "), F.lit("]")).alias("pages"), F.array_join(F.flatten("grid"), "|").alias("grid"))


@query("choose_band", f"""WITH {_RECTS}, {_ANCHORS}, b AS (SELECT paper_id, pno, anchor_id AS band_id, c0 AS x0, CASE WHEN anchor_id % 2 = 0 THEN y0 - 150 ELSE y1 END AS y0, c0 + 300 AS x1, CASE WHEN anchor_id % 2 = 0 THEN y0 ELSE y1 + 15 * (anchor_id % 7) END AS y1, c0, anchor_id % 2 = 0 AS up FROM a),
    l AS (SELECT b.band_id, min(r.x0) AS a0, min(r.y0) AS b0, max(r.x0 + 200) AS a1, max(r.y0 + 1) AS b1 FROM b JOIN (SELECT * FROM r) r USING (paper_id, pno) WHERE r.y0 >= b.y0 - 2 AND r.y0 + 1 <= b.y1 + 2 AND greatest(0, least(r.x0 + 200, c0 + 300) - greatest(r.x0, c0)) > 120 GROUP BY ALL),
    s AS (SELECT b.*, a0, b0, a1, b1, y1 - y0 BETWEEN 24 AND 680 AS sane FROM b LEFT JOIN l USING (band_id))
    SELECT band_id, CASE WHEN NOT sane THEN 'low' WHEN a0 IS NOT NULL THEN 'high' ELSE 'medium' END AS trust, CAST(CASE WHEN NOT sane THEN 0 WHEN a0 IS NOT NULL THEN least(a0 - 6, x0) ELSE x0 END AS DOUBLE) AS x0, CAST(CASE WHEN NOT sane THEN 0 WHEN a0 IS NOT NULL AND up THEN greatest(y0, b0 - 8) ELSE y0 END AS DOUBLE) AS y0,
    CAST(CASE WHEN NOT sane THEN 600 WHEN a0 IS NOT NULL THEN greatest(a1 + 6, x1) ELSE x1 END AS DOUBLE) AS x1, CAST(CASE WHEN NOT sane THEN 800 WHEN a0 IS NOT NULL AND NOT up THEN least(y1, b1 + 8) ELSE y1 END AS DOUBLE) AS y1 FROM s""")
def choose_band(spark, sf):
    even = F.col("anchor_id") % 2 == 0
    a = _anchors(spark, sf)
    bands = a.select("paper_id", "pno", F.col("anchor_id").alias("band_id"), F.col("col_x0").alias("x0"), F.when(even, F.col("y0") - 150).otherwise(F.col("y1")).alias("y0"), F.col("col_x1").alias("x1"), F.when(even, F.col("y0")).otherwise(F.col("y1") + 15 * (F.col("anchor_id") % 7)).alias("y1"), "col_x0", "col_x1", F.when(even, "above").otherwise("below").alias("side"))
    r = _rects(spark, sf)
    rules = r.select("paper_id", "pno", "x0", "y0", (F.col("x0") + 200).alias("x1"), (F.col("y0") + 1).alias("y1"))
    return layout.choose_band(bands, rules, _pages(spark, sf)).select("band_id", "trust", "x0", "y0", "x1", "y1")


@query("nearest_rule_gap", f"""WITH {_RECTS}, {_ANCHORS}, b AS (SELECT paper_id, pno, anchor_id AS band_id, c0, y1 AS b0, y1 + 200 AS b1 FROM a)
    SELECT b.band_id, CAST(min(r.y0) - any_value(b0) AS DOUBLE) AS gap FROM b JOIN (SELECT * FROM r) r USING (paper_id, pno) WHERE r.y0 >= b0 - 2 AND r.y0 + 1 <= b1 + 2 AND greatest(0, least(r.x0 + 200, c0 + 300) - greatest(r.x0, c0)) > 120 GROUP BY b.band_id""")
def nearest_rule_gap(spark, sf):
    bands = _anchors(spark, sf).select("paper_id", "pno", F.col("anchor_id").alias("band_id"), F.col("col_x0").alias("x0"), F.col("y1").alias("y0"), F.col("col_x1").alias("x1"), (F.col("y1") + 200).alias("y1"), "col_x0", "col_x1", F.lit("below").alias("side"))
    r = _rects(spark, sf)
    rules = r.select("paper_id", "pno", "x0", "y0", (F.col("x0") + 200).alias("x1"), (F.col("y0") + 1).alias("y1"))
    return layout.nearest_gap(bands, rules).select("band_id", "gap")


@query("assign_rows", "SELECT CAST(n_regionkey AS BIGINT) AS table_id, 'c' || k || '-' || n_nationkey AS text, row_number() OVER (PARTITION BY n_regionkey, k ORDER BY n_nationkey) - 1 AS row FROM nation, range(3) r(k)")
def assign_rows(spark, sf):
    w = _cells(spark, sf).withColumn("y0", F.col("row") * 20.0 + F.col("x0") % 2).withColumn("y1", F.col("y0") + 10).withColumn("table_id", F.col("table_id").cast("long"))
    return layout.assign_rows(w.drop("row")).select("table_id", "text", "row")


@query("placement", """SELECT CAST(c_custkey AS VARCHAR) AS paper_id, c_custkey AS anchor_id, CASE c_custkey % 3 WHEN 0 THEN 56.0 WHEN 1 THEN 56.0 ELSE 44.0 END::DOUBLE AS x0, CASE c_custkey % 3 WHEN 0 THEN 56.0 WHEN 1 THEN 96.0 ELSE 40.0 END::DOUBLE AS y0,
    CASE c_custkey % 3 WHEN 0 THEN 544.0 WHEN 1 THEN 504.0 ELSE 556.0 END::DOUBLE AS x1, CASE c_custkey % 3 WHEN 0 THEN 304.0 + c_custkey % 100 WHEN 1 THEN 454.0 ELSE 500.0 END::DOUBLE AS y1,
    CASE c_custkey % 3 WHEN 0 THEN 'journal_raster' WHEN 1 THEN 'latex_vector' ELSE 'fallback_band' END AS route, CASE c_custkey % 3 WHEN 2 THEN 'medium' ELSE 'high' END AS trust FROM customer""")
def placement(spark, sf):
    from figmill.operators import place

    c, k = load(spark, sf, "customer")["customer"], F.col("c_custkey")
    lit = lambda **cols: [F.lit(v).cast("double").alias(n) for n, v in cols.items()]
    at = [k.cast("string").alias("paper_id"), F.lit(0).alias("pno")]
    route = F.when(k % 3 == 0, "journal_raster").otherwise("latex_vector").alias("route")
    pages = c.select(*at, *lit(width=600, height=800, content_x0=50, content_x1=550, content_top=40, content_bottom=760), route, F.lit(False).alias("is_figure_page"), F.lit(True).alias("has_graphics"))
    images = c.filter(k % 3 == 0).select(*at, *lit(x0=60, y0=60, x1=540), (300 + k % 100).cast("double").alias("y1"))
    own = [F.when(k % 3 == 1, F.lit(v)).cast("double").alias(n) for n, v in (("g_x0", 60), ("g_y0", 100), ("g_x1", 500), ("g_y1", 450), ("coverage", 1))]
    anchors = c.select(*at, k.alias("anchor_id"), F.lit("figure").alias("kind"), F.lit("").alias("series"), F.lit("1").alias("number"), *lit(x0=60, y0=500, x1=300, y1=510, col_x0=50, col_x1=550, ceiling=40), *own)
    return place.place(anchors, pages, images, images.limit(0)).select("paper_id", "anchor_id", "x0", "y0", "x1", "y1", "route", "trust")
