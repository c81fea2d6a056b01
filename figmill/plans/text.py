"""Queries over text: citations, captions, labels, recall. Sentences are made from keys, so the oracles know their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from figmill.functions import exprs, kernels, text
from figmill.operators import recall, tasks
from figmill.plans.registry import query
from figmill.plans.synthetic import load


def _case(key: str, options: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


_A, _B = "CAST(1 + p_partkey % 9 AS STRING)", "CAST(3 + p_partkey % 9 AS STRING)"
_SENTENCES = [f"concat('as shown in Fig. ', {_A}, 'A, the rate rose')", f"concat('Figures ', {_A}, '-', {_B}, ' compare them')", f"concat('see Tables ', {_A}, ' and ', {_B})", f"concat('(Fig. ', {_A}, ', 2 h after treatment)')", f"concat('在图 ', {_A}, '、', {_B}, ' 中')", "'the table 3% of it'", f"concat('Supplementary Fig. S', {_A}, '(a-c)')", "'Table IV lists it'"]
_CITED = ["['figure:' || a || ':A']", "['figure:' || a || ':', 'figure:' || m || ':', 'figure:' || b || ':']", "['table:' || a || ':', 'table:' || b || ':']", "['figure:' || a || ':']", "['figure:' || a || ':', 'figure:' || b || ':']", "[]::VARCHAR[]", "['figure:S' || a || ':A,B,C']", "['table:4:']"]


@query("citation_scan", f"""SELECT p_partkey, array_to_string({_case("p_partkey % 8", _CITED)}, ' ') AS refs FROM (SELECT p_partkey, CAST(1 + p_partkey % 9 AS VARCHAR) AS a, CAST(2 + p_partkey % 9 AS VARCHAR) AS m, CAST(3 + p_partkey % 9 AS VARCHAR) AS b FROM part)""")
def citation_scan(spark, sf):
    p = load(spark, sf, "part")["part"].select("p_partkey", F.expr(_case("p_partkey % 8", _SENTENCES)).alias("t"))
    refs = F.transform(kernels.citations(F.col("t")), lambda r: F.concat(r["kind"], F.lit(":"), r["number"], F.lit(":"), F.array_join(r["panels"], ",")))
    return p.select("p_partkey", F.array_join(refs, " ").alias("refs"))


@query("citing_join", """WITH c AS (SELECT CAST(o_custkey % 25 AS VARCHAR) AS paper_id, 'Figure ' || (1 + o_orderkey % 40) AS figure_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 25, o_orderkey % 40 ORDER BY o_orderkey) AS nth FROM orders),
    a AS (SELECT CAST(n_nationkey AS VARCHAR) AS paper_id, 'Figure ' || k AS figure_id FROM nation, range(3, 46) r(k))
    SELECT a.paper_id, a.figure_id, count(nth) FILTER (nth <= 12) AS kept, count(nth) FILTER (nth > 12) AS over FROM a LEFT JOIN c USING (paper_id, figure_id) GROUP BY ALL""")
def citing_join(spark, sf):
    t = load(spark, sf, "orders", "nation")
    said = F.concat(F.lit("Details are in Fig. "), (1 + F.col("o_orderkey") % 40).cast("string"), F.lit(" of this paper."))
    paragraphs = t["orders"].select((F.col("o_custkey") % 25).cast("string").alias("paper_id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("¶"), F.col("o_orderkey")).alias("id"), said.alias("text"))
    assets = t["nation"].select(F.col("n_nationkey").cast("string").alias("paper_id"), F.explode(F.sequence(F.lit(3), F.lit(45))).alias("k"))  # some are cited nowhere, some citations have no asset
    assets = assets.select("paper_id", F.concat(F.lit("Figure "), F.col("k")).alias("figure_id"), F.lit("figure").alias("kind"), F.lpad(F.col("k").cast("string"), 2, "0").alias("number"), F.lit("Figure caption").alias("caption"))
    return recall.citing(assets, paragraphs).groupBy("paper_id", "figure_id").agg(F.count(F.when(~F.col("over"), 1)).alias("kept"), F.count(F.when(F.col("over"), 1)).alias("over"))


_NUMBERS = ["lpad(CAST(p_size AS STRING), 3, '0')", "concat('S ', p_size)", "'IV'", "'xiv'", "concat(' ', p_size, ' ')", "'A-1'"]
_NORMAL = ["CAST(p_size AS VARCHAR)", "'S' || p_size", "'4'", "'14'", "CAST(p_size AS VARCHAR)", "'A-1'"]


@query("norm_number", f"SELECT p_partkey, {_case('p_partkey % 6', _NORMAL)} AS number FROM part")
def norm_number(spark, sf):
    return load(spark, sf, "part")["part"].select("p_partkey", exprs.norm_number(F.expr(_case("p_partkey % 6", _NUMBERS))).alias("number"))


_ENDS = text.WORD_ENDINGS.split()
_ENDS_SQL = "[" + ", ".join(f"'{e}'" for e in _ENDS) + "]"


@query("dehyphenate", f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x imply' || e || ' a ' || p_name WHEN 1 THEN 'x Protein-protein ' || e ELSE 'a - b-' || e END AS t FROM (SELECT p_partkey, p_name, {_ENDS_SQL}[1 + p_partkey % {len(_ENDS)}] AS e FROM part)""")
def dehyphenate(spark, sf):
    e = F.element_at(F.array(*map(F.lit, _ENDS)), (1 + F.col("p_partkey") % len(_ENDS)).cast("int"))
    kind = F.col("p_partkey") % 3
    t = F.when(kind == 0, F.concat(F.lit("x imply- "), e, F.lit(" a "), "p_name")).when(kind == 1, F.concat(F.lit("x Protein- protein "), e)).otherwise(F.concat(F.lit("a - b-"), e))
    return load(spark, sf, "part")["part"].select("p_partkey", text.dehyphenate(t).alias("t"))


_CAPS = [
    "concat('Fig. ', k, '. Overview of ', nm, '. (A) Growth of ', nm, ' cells. (B) Death of ', nm, ' cells. * indicates p < 0.05, n = 3.')",
    "concat('Figure ', k, ' | Effects. a, The growth of ', nm, '. b,c, The death of ', nm, ' and others.')",
    "concat('Figure ', k, '. As shown in (B) the plain ', nm, ' remains.')",
    "concat('Fig. ', k, ': (A-C) Three views of ', nm, '. (D) One more ', nm, ' view; and')",
]
_PARTS = [
    "'A=Growth of ' || nm || ' cells.;B=Death of ' || nm || ' cells.|Overview of ' || nm || '|* indicates p < 0.05, n = 3.'",
    "'A=The growth of ' || nm || '.;B=The death of ' || nm || ' and others.;C=The death of ' || nm || ' and others.|Effects|'",
    "'||'",
    "'A=Three views of ' || nm || '.;B=Three views of ' || nm || '.;C=Three views of ' || nm || '.;D=One more ' || nm || ' view||'",
]


@query("panel_split", f"SELECT c_custkey, {_case('c_custkey % 4', _PARTS)} AS parts FROM (SELECT c_custkey, lower(c_mktsegment) AS nm FROM customer)")
def panel_split(spark, sf):
    c = load(spark, sf, "customer")["customer"].select("c_custkey", F.lower("c_mktsegment").alias("nm"), (F.col("c_custkey") % 900).alias("k"))
    s = c.select("c_custkey", kernels.panel_split(F.expr(_case("c_custkey % 4", _CAPS))).alias("s"))
    panels = F.array_join(F.transform("s.panels", lambda p: F.concat(p["label"], F.lit("="), p["text"])), ";")
    return s.select("c_custkey", F.concat(panels, F.lit("|"), "s.preamble", F.lit("|"), "s.trailer").alias("parts"))


_HEADS = ["concat('Figure ', c_custkey % 900, '. Text')", "concat('Extended Data Fig. ', c_custkey % 900, ' | Text')", "concat('表 ', c_custkey % 900, '：文')", "concat('Supplementary Table IV (continued). Text ', c_custkey)", "concat('As shown in Figure ', c_custkey)", "concat('Fig ', c_custkey % 900, 'b: x')"]
_ANCHORS = ["'figure||' || (c_custkey % 900) || '|false|Figure ' || (c_custkey % 900)", "'figure|extended data|' || (c_custkey % 900) || '|false|Extended Data Figure ' || (c_custkey % 900)", "'table||' || (c_custkey % 900) || '|false|Table ' || (c_custkey % 900)", "'table|supplementary|IV|true|Supplementary Table IV'", "NULL", "'figure||' || (c_custkey % 900) || '|false|Figure ' || (c_custkey % 900)"]


@query("caption_anchor", f"SELECT c_custkey, {_case('c_custkey % 6', _ANCHORS)} AS anchor FROM customer")
def caption_anchor(spark, sf):
    a = load(spark, sf, "customer")["customer"].select("c_custkey", text.caption_anchor(F.expr(_case("c_custkey % 6", _HEADS))).alias("a"))
    shown = F.concat("a.kind", F.lit("|"), "a.series", F.lit("|"), "a.number", F.lit("|"), F.col("a.is_continued").cast("string"), F.lit("|"), text.canonical_id(F.col("a.kind"), F.col("a.series"), F.col("a.number")))
    return a.select("c_custkey", shown.alias("anchor"))


@query("dedupe_anchors", "SELECT p_brand, p_type, max(p_size) AS size, arg_min(p_partkey, p_partkey) FILTER (p_size = m) AS first_key FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand, p_type) AS m FROM part) GROUP BY ALL")
def dedupe_anchors(spark, sf):
    p = load(spark, sf, "part")["part"].withColumn("text", F.repeat(F.lit("x"), F.col("p_size")))
    best = tasks.longest_first(p, ["p_brand", "p_type"], "text", "p_partkey")
    return best.select("p_brand", "p_type", F.length("text").alias("size"), F.col("p_partkey").alias("first_key"))


@query("figure_title", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Growth at 0.5 mM of ' || c_mktsegment WHEN 1 THEN 'Rates of E. coli vs. yeast' ELSE '生长曲线' END AS title FROM customer")
def figure_title(spark, sf):
    c = load(spark, sf, "customer")["customer"]
    k = F.col("c_custkey") % 3
    cap = F.when(k == 0, F.concat(F.lit("Fig. 3. Growth at 0.5 mM of "), "c_mktsegment", F.lit(". More text follows."))).when(k == 1, F.lit("Figure 2: Rates of E. coli vs. yeast. Then more.")).otherwise("图 1．生长曲线。其余。")
    return c.select("c_custkey", kernels.title(cap).alias("title"))


_WORDS = "['HeLa', 'BERT', 'GLUE', 'DMSO', 'BLEU', 'dropout', 'antibody', 'ELISA']"


@query("keyword_topk", f"""WITH d AS (SELECT doc_id, {_WORDS}[1 + doc_id % 8] AS w, {_WORDS}[1 + (doc_id + 3) % 8] AS v FROM documents),
    k(w, wt) AS (VALUES ('HeLa', 1.6), ('BERT', 1.6), ('GLUE', 1.6), ('DMSO', 1.4), ('BLEU', 1.1), ('dropout', 0.8), ('antibody', 0.6), ('ELISA', 1.4)),
    x AS (SELECT doc_id, lower(d.w) AS key, 2 * wt AS weight FROM d JOIN k ON d.w = k.w UNION ALL SELECT doc_id, lower(v), wt FROM d JOIN k ON v = k.w)
    SELECT doc_id AS doc, key, CAST(round(weight * 10) AS INT) AS weight, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, key) AS INT) AS rank FROM x""")
def keyword_topk(spark, sf):
    d = load(spark, sf, "documents")["documents"]
    words = F.array(*map(F.lit, ["HeLa", "BERT", "GLUE", "DMSO", "BLEU", "dropout", "antibody", "ELISA"]))
    pick = lambda k: F.element_at(words, (1 + (F.col("doc_id") + k) % 8).cast("int"))
    cap = d.select(F.col("doc_id").alias("doc"), F.lit("caption").alias("origin"), F.concat(F.lit("the "), pick(0), F.lit(" line")).alias("text"))
    body = d.select(F.col("doc_id").alias("doc"), F.lit("body").alias("origin"), F.concat(F.lit("with "), pick(3), F.lit(", washed")).alias("text"))
    return recall.keywords(cap.unionByName(body), recall.term_table(spark)).select("doc", "key", F.round(F.col("weight") * 10).cast("int").alias("weight"), "rank")


@query("methods_recall", """WITH p AS (SELECT c_nationkey AS doc, c_custkey AS ord, c_custkey % 5 AS k FROM customer),
    s AS (SELECT doc, ord, CASE k WHEN 0 THEN 3.2 + 0.5 WHEN 1 THEN 0.6 WHEN 2 THEN 3.8 ELSE NULL END AS score FROM p),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY score DESC, 'm' || ord) AS r FROM s WHERE score >= 1),
    b AS (SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY ord) AS r FROM p WHERE doc NOT IN (SELECT doc FROM h)), f AS (SELECT * FROM b WHERE r <= 2),
    t AS (SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY ord) AS r FROM p WHERE k = 4 AND ord NOT IN (SELECT ord FROM f))
    SELECT doc, 'm' || ord AS id, CAST(round(score * 100) AS INT) AS score, 'hit' AS how FROM h WHERE r <= 5 UNION ALL SELECT doc, 'm' || ord, 0, 'fallback' FROM f UNION ALL SELECT doc, 'm' || ord, 0, 'pinned' FROM t WHERE r <= 2""")
def methods_recall(spark, sf):
    c = load(spark, sf, "customer")["customer"]
    k = F.col("c_custkey") % 5
    said = F.when(k == 0, "HeLa cells were used").when(k == 1, "an antibody").when(k == 2, "antibodies? no: one antibody for HeLa").otherwise("nothing of note")
    titles = F.when(k == 0, "Materials").when(k == 4, "Statistical analysis").otherwise("Results")
    paragraphs = c.select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("ord"), F.concat(F.lit("m"), "c_custkey").alias("id"), titles.alias("title"), said.alias("text"), F.lit(False).alias("excluded"))
    words = recall.term_table(spark, {"cell_line": ["HeLa"], "generic": ["antibody"]})
    rows = c.select(F.col("c_nationkey").alias("doc")).distinct().join(F.broadcast(words)).select("doc", "pattern", (F.col("weight") * F.when(F.col("term") == "HeLa", 2.0).otherwise(1.0)).alias("weight"), F.lit("caption").alias("origin"))
    return recall.methods(rows, paragraphs).select("doc", "id", F.round(F.col("score") * 100).cast("int").alias("score"), "how")


@query("breadcrumb", "SELECT r_name AS paper_id, '§' || r_regionkey || '.' || n_nationkey || '.' || c_custkey AS id, '§' || r_regionkey || ' ' || r_name || ' › §' || r_regionkey || '.' || n_nationkey || ' ' || n_name || ' › §' || r_regionkey || '.' || n_nationkey || '.' || c_custkey || ' ' || c_name AS trail FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def breadcrumb(spark, sf):
    t = load(spark, sf, "customer", "nation", "region")
    n = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    c = t["customer"].join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    mark = lambda *x: F.concat(F.lit("§"), F.concat_ws(".", *x))
    top = t["region"].select(F.col("r_name").alias("paper_id"), mark("r_regionkey").alias("id"), F.col("r_name").alias("title"))
    mid = n.select(F.col("r_name").alias("paper_id"), mark("r_regionkey", "n_nationkey").alias("id"), F.col("n_name").alias("title"))
    low = c.select(F.col("r_name").alias("paper_id"), mark("r_regionkey", "n_nationkey", "c_custkey").alias("id"), F.col("c_name").alias("title"))
    return recall.breadcrumbs(top.unionByName(mid).unionByName(low)).filter(F.size(F.split("id", r"\.")) == 3)


@query("slugs", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'fig_' || lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0') WHEN 1 THEN 'edfig_' || lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0') WHEN 2 THEN 'tab_14' ELSE 'stab_s' || lpad(CAST(c_custkey % 90 AS VARCHAR), 2, '0') END AS stem,
    'extended_data_figure_' || CASE WHEN c_custkey < 10 THEN '0' ELSE '' END || c_custkey AS slug, 'Figure ' || c_custkey AS back FROM customer""")
def slugs(spark, sf):
    c = load(spark, sf, "customer")["customer"]
    k, n = F.col("c_custkey") % 4, (F.col("c_custkey") % 90).cast("string")
    kind = F.when(k < 2, "figure").otherwise("table")
    series = F.when(k == 1, "extended data").when(k == 3, "supplementary").otherwise("")
    number = F.when(k == 2, "XIV").when(k == 3, F.concat(F.lit("S"), n)).otherwise(n)
    return c.select("c_custkey", text.asset_stem(kind, series, number).alias("stem"), text.record_slug(F.concat(F.lit("Extended Data Figure "), "c_custkey")).alias("slug"), text.figure_id_of_slug(F.concat(F.lit("figure_0"), "c_custkey")).alias("back"))


@query("display_width", "SELECT p_partkey, length(p_name) + 2 * (p_partkey % 5) AS width, CASE WHEN length(p_name) + p_partkey % 5 > 8 THEN rtrim(substr(p_name || repeat('宽', CAST(p_partkey % 5 AS INT)), 1, 7)) || '…' ELSE p_name || repeat('宽', CAST(p_partkey % 5 AS INT)) END AS cut, CASE WHEN 2 * (p_partkey % 5) <= 5 THEN repeat('宽', CAST(p_partkey % 5 AS INT)) ELSE '宽宽…' END AS fit FROM part")
def display_width(spark, sf):
    wide = F.repeat(F.lit("宽"), (F.col("p_partkey") % 5).cast("int"))
    t = F.concat("p_name", wide)
    return load(spark, sf, "part")["part"].select("p_partkey", exprs.display_width(t).alias("width"), exprs.truncated(t, 8).alias("cut"), exprs.truncated_to_width(wide, 5).alias("fit"))


_MERMAID = f"translate(trim(regexp_replace(t, '\\s+', ' ', 'g')), '{exprs.MERMAID_FROM}', '{exprs.MERMAID_TO}')"
_CELL = "replace(replace(replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), '\\', '\\\\'), '|', '\\|'), '<', '&lt;')"


@query("escapes", f"""SELECT p_partkey, {_MERMAID} AS mermaid, {_CELL} AS cell, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS attr FROM (SELECT p_partkey, p_name || ' <b>"' || p_brand || '" & (x|y) ' AS t FROM part)""")
def escapes(spark, sf):
    t = F.concat("p_name", F.lit(' <b>"'), "p_brand", F.lit('" & (x|y) '))
    return load(spark, sf, "part")["part"].select("p_partkey", exprs.mermaid_text(t).alias("mermaid"), exprs.md_cell(t).alias("cell"), exprs.xml_attr(t).alias("attr"))


@query("page_spec", "SELECT c_custkey, list_sort(list_distinct(list_concat(range(1 + c_custkey % 5, 4 + c_custkey % 5), [2])))::VARCHAR AS pages FROM customer")
def page_spec(spark, sf):
    a = (1 + F.col("c_custkey") % 5).cast("string")
    spec = F.concat(a, F.lit("-"), (3 + F.col("c_custkey") % 5).cast("string"), F.lit(" ,2,x,2"))
    return load(spark, sf, "customer")["customer"].select("c_custkey", F.concat(F.lit("["), F.array_join(text.page_numbers(spec).cast("array<string>"), ", "), F.lit("]")).alias("pages"))


@query("figure_select", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey BETWEEN 2 AND 40 OR c_custkey = 77)")
def figure_select(spark, sf):
    series = F.when(F.col("c_custkey") % 3 == 0, "extended data").otherwise("")
    figure = F.concat(F.when(F.col("c_custkey") % 3 == 0, "Extended Data ").otherwise(""), F.lit("Figure "), "c_custkey")
    return load(spark, sf, "customer")["customer"].filter(text.figure_selected("main，2-40,77", figure, series)).select("c_custkey")


@query("natural_sort", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_mktsegment), c_custkey) AS place FROM customer")
def natural_sort(spark, sf):
    from pyspark.sql import Window

    c = load(spark, sf, "customer")["customer"]
    key = exprs.natural_key(F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(key)).cast("long").alias("place"))


@query("task_sections", """WITH s AS (SELECT c_custkey, unnest(['intro', 'caption', 'panels', 'methods', 'grid', 'check']) AS key, unnest([1, 2, 3, 4, 5, 6]) AS k FROM customer),
    v AS (SELECT * FROM s WHERE NOT (key = 'grid' AND c_custkey % 2 = 0) AND NOT (key = 'methods' AND c_custkey % 3 = 0))
    SELECT c_custkey AS ord, string_agg('## ' || n || '. ' || key, chr(10) ORDER BY n) AS doc FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY k) AS n FROM v) GROUP BY c_custkey""")
def task_sections(spark, sf):
    c = load(spark, sf, "customer")["customer"]
    keys = ["intro", "caption", "panels", "methods", "grid", "check"]
    rows = c.select(F.col("c_custkey").alias("ord"), F.posexplode(F.array(*map(F.lit, keys))).alias("k", "key"))
    body = F.when((F.col("key") == "grid") & (F.col("ord") % 2 == 0), "").otherwise(F.lit("x"))
    level = F.when(F.col("ord") % 3 == 0, "light").otherwise("full")
    return tasks.numbered(rows.withColumn("body", body).withColumn("level", level), {"light": ["methods"]})


@query("formatters", """SELECT c_custkey, 'p.' || CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 50 || '-' || (c_custkey % 50 + 1) ELSE CAST(c_custkey % 50 AS VARCHAR) END AS pages, '§' || (c_custkey % 9) || ' x；§y' AS refs,
    CASE c_custkey % 3 WHEN 0 THEN '高 ⚠' WHEN 1 THEN '中' ELSE '低' END AS trust FROM customer""")
def formatters(spark, sf):
    c = load(spark, sf, "customer")["customer"]
    n = (F.col("c_custkey") % 50).cast("int")
    pages = F.when(F.col("c_custkey") % 2 == 0, F.array(n, n + 1)).otherwise(F.array(n))
    refs = F.array(F.concat(F.lit("§"), (F.col("c_custkey") % 9).cast("string"), F.lit("  x")), F.lit("§y"))
    confidence = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select("c_custkey", tasks.pages_label(pages).alias("pages"), exprs.joined(F.transform(refs, exprs.norm_ws)).alias("refs"), tasks.trust_label(confidence, F.col("c_custkey") % 3 == 0).alias("trust"))
