"""Documents from records: notes, context packs, tasks and pages, one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions.exprs import clean_sentinel, evidence_summary, joined, md_cell, shown
from figmill.operators.corpus import mermaid, opml, tree
from figmill.operators.flatten import group_cell, groups, panels, result_cell
from figmill.operators.metrics import kpi
from figmill.operators.tasks import pages_label, trust_label


def _table(rows: Column, head: list[str]) -> Column:
    lines = F.concat(F.array(F.lit("| " + " | ".join(head) + " |"), F.lit("|" + " --- |" * len(head))), rows)
    return F.array_join(lines, "\n")


def panel_section(p: Column) -> Column:
    """A panel as Markdown: its experiment, groups, statistics and sources."""
    rows = F.transform(p["groups"], lambda g: F.concat(F.lit("| "), F.array_join(F.array(md_cell(group_cell(g)), F.coalesce(g["role"], F.lit("")), md_cell(clean_sentinel(g["n"])), md_cell(result_cell(g))), " | "), F.lit(" |")))
    stats = F.concat(F.lit("- 统计: "), shown(p["stats"]["test"]), F.lit(" / "), shown(p["stats"]["error_bar"]), F.lit(" / "), shown(p["stats"]["significance"]))
    parts = F.array(F.concat(F.lit("### "), p["label"]), shown(p["experiment"]), F.concat(F.lit("- 自变量: "), shown(p["design"]["independent_var"]), F.lit(" ("), joined(p["design"]["levels"], " / "), F.lit(")")), _table(rows, ["分组", "角色", "n", "结果"]), stats, F.concat(F.lit("- 证据: "), evidence_summary(p["evidence"])))
    return F.array_join(parts, "\n")


def notes(records: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Markdown notes of each figure: paper_id, ord, figure_id, doc. Reasons to review mark the trust shown."""
    r = records
    if reasons is not None:
        flagged = reasons.filter("kind = 'sentinel'").select("paper_id", "figure_id").distinct().withColumn("flagged", F.lit(True))
        r = r.join(flagged, ["paper_id", "figure_id"], "left")
    flag = F.coalesce("flagged", F.lit(False)) if reasons is not None else F.lit(False)
    head = F.concat(F.lit("## "), "figure_id", F.lit(" · "), pages_label(F.col("pages")), F.lit(" · "), trust_label(F.col("confidence"), flag))
    doc = F.array_join(F.concat(F.array(head, F.concat(F.lit("> "), F.coalesce("caption", F.lit("")))), F.transform("panels", panel_section)), "\n\n")
    return r.select("paper_id", "ord", "figure_id", doc.alias("doc"))


def paper_notes(records: DataFrame, reasons: DataFrame, warnings: DataFrame) -> DataFrame:
    """The notes of each paper as one Markdown text: its counts, its figures in order, a checklist of what to review, its warnings.

    Figures of medium trust without another reason are listed after the reasons.
    """
    lines = lambda df, order: df.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n").alias("doc"))
    sections = notes(records, reasons).groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "doc"))), lambda x: x["doc"]), "\n\n").alias("figures"))
    head = records.groupBy("paper_id").agg(F.concat(F.lit("# "), F.coalesce(F.min_by("paper.title", "ord"), F.lit("")), F.lit("\n\n- 图 "), F.count("*").cast("string"), F.lit(" · panel "), F.sum(F.size("panels")).cast("string")).alias("head"))
    said = reasons.join(records.select("paper_id", "figure_id", F.col("ord").alias("at")), ["paper_id", "figure_id"])
    said = said.select("paper_id", "at", F.lit(0).alias("k"), F.concat(F.lit("- [ ] "), "figure_id", F.lit(": "), md_cell(F.col("text"))).alias("line"))
    medium = records.filter("confidence = 'medium'").join(reasons.select("paper_id", "figure_id"), ["paper_id", "figure_id"], "left_anti")
    medium = medium.select("paper_id", F.col("ord").alias("at"), F.lit(1).alias("k"), F.concat(F.lit("- [ ] "), "figure_id", F.lit(": 置信度 中")).alias("line"))
    checks = lines(said.unionByName(medium), ["k", "at"]).withColumnRenamed("doc", "checks")
    warned = lines(warnings.select("paper_id", "ord", F.concat(F.lit("- "), md_cell(F.col("warning"))).alias("line")), ["ord"]).withColumnRenamed("doc", "warned")
    whole = head.join(sections, "paper_id").join(checks, "paper_id", "left").join(warned, "paper_id", "left")
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"## {title}\n\n"), c))
    return whole.select("paper_id", F.concat_ws("\n\n", "head", "figures", part("复核清单", "checks"), part("警告", "warned")).alias("doc"))


def figure_tables(records: DataFrame) -> DataFrame:
    """The groups of each figure as one Markdown table: paper_id, ord, figure_id, doc."""
    rows = groups(panels(records)).select("paper_id", "ord", "figure_id", "panel_idx", "group_idx", F.concat(F.lit("| "), F.array_join(F.array(md_cell(F.col("p.label")), md_cell(group_cell(F.col("g"))), md_cell(clean_sentinel(F.col("g.n"))), md_cell(result_cell(F.col("g")))), " | "), F.lit(" |")).alias("line"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("panel_idx", "group_idx", "line"))), lambda x: x["line"])
    return rows.groupBy("paper_id", "ord", "figure_id").agg(F.concat(F.lit("## "), F.first("figure_id"), F.lit("\n\n"), _table(body, ["panel", "分组", "n", "结果"])).alias("doc"))


def mindmaps(records: DataFrame, depth: int = 3) -> DataFrame:
    """Each paper's mind map: paper_id, mermaid, opml."""
    nodes = paper_tree(records, depth).withColumnRenamed("paper_id", "ord")
    drawn = mermaid(nodes).select(F.col("ord").alias("paper_id"), F.concat(F.lit("mindmap\n"), "doc").alias("mermaid"))
    outline = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n<head/>\n<body>\n'), "doc", F.lit("\n</body>\n</opml>"))
    return drawn.join(opml(nodes).select(F.col("ord").alias("paper_id"), outline.alias("opml")), "paper_id")


def context_packs(packs: DataFrame) -> DataFrame:
    """Markdown of context packs as context.packs gives them: caption and its parts, citing paragraphs, methods with why they were recalled."""
    item = lambda x: F.concat(F.lit("- "), x["id"], F.lit(": "), x["text"])
    why = lambda x: F.concat(item(x), F.lit(" ("), x["how"], F.when(x["score"] > 0, F.concat(F.lit(" "), x["score"].cast("string"))).otherwise(""), F.lit(")"))
    section = lambda title, items: F.when(F.size(items) > 0, F.concat(F.array(F.lit(f"## {title}")), items)).otherwise(F.array().cast("array<string>"))
    text = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    s = F.col("split")
    parts = F.concat(
        F.array(F.concat(F.lit("# "), "figure_id"), F.lit("## Caption"), F.coalesce("caption", F.lit(""))),
        section("Overview", text(s["preamble"])),
        section("Panels", F.transform(s["panels"], lambda p: F.concat(F.lit("- "), p["label"], F.lit(": "), p["text"]))),
        section("For all panels", text(s["trailer"])),
        section("Cited in", F.transform("citing", item)),
        section("Cited in as well", F.when(F.size("over") > 0, F.array(F.array_join("over", ", "))).otherwise(F.array().cast("array<string>"))),
        section("Keywords", F.when(F.size("keywords") > 0, F.array(F.array_join("keywords", ", "))).otherwise(F.array().cast("array<string>"))),
        section("Methods", F.transform("methods", why)),
    )
    return packs.select("paper_id", "figure_id", F.array_join(parts, "\n").alias("doc"))


def page_data(records: DataFrame) -> DataFrame:
    """The data of one page: headline numbers and compact figures, as one JSON text a paper."""
    per = F.to_json(F.struct(F.col("figure_id").alias("id"), F.col("figure_kind").alias("kind"), F.col("confidence").alias("trust"), F.transform("panels", lambda p: F.struct(p["label"].alias("label"), F.size(p["groups"]).alias("groups"))).alias("panels")))
    return records.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", per.alias("j")))), lambda x: x["j"]), ",").alias("figures"))


def tiles(records: DataFrame) -> DataFrame:
    """Headline numbers as label and text."""
    k = kpi(records)
    pairs = [("figures", "figures", ""), ("panels", "panels", ""), ("groups", "groups", ""), ("n", "n_rate", "%"), ("test", "test_rate", "%"), ("review", "review", "")]
    return k.select(F.explode(F.array(*[F.struct(F.lit(a).alias("tile"), F.concat(F.col(c).cast("string"), F.lit(u)).alias("text")) for a, c, u in pairs])).alias("t")).select("t.*")


def provenance(records: DataFrame) -> DataFrame:
    """One line a panel: where its values come from."""
    return panels(records).select("paper_id", "ord", "panel_idx", F.concat("figure_id", F.lit(" "), "p.label", F.lit(" ← "), evidence_summary(F.col("p.evidence"))).alias("line"))


#: Columns, first row and row height of a drawn tree; characters of a title in the rail; how a caption names its main figure.
TREE_X, TREE_TOP, TREE_ROW, RAIL_CHARS = [16, 330, 700, 1090], 26, 21, 30
RELATED = r"(?i)related\s+to\s+(?:Extended\s+Data\s+)?Fig(?:ure)?\.?\s*([0-9]+)"


def _flow_figures(records: DataFrame) -> DataFrame:
    number = F.regexp_extract("figure_id", r"([0-9]+)", 1).try_cast("int")
    related = F.regexp_extract(F.coalesce("caption", F.lit("")), RELATED, 1).try_cast("int")
    return records.select("paper_id", "ord", "figure_id", number.alias("number"), related.alias("related"), F.col("figure_id").startswith("Extended Data").alias("extended"))


def flow_links(records: DataFrame) -> DataFrame:
    """The flow of a paper: main figures in a chain by number, Extended Data on the main figure that its caption names, orphans without a source.

    paper_id, kind (chain, branch, orphan), source, target; the first of a chain has no source.
    """
    f = _flow_figures(records)
    main = f.filter("NOT extended")
    before = F.lag("figure_id").over(Window.partitionBy("paper_id").orderBy("number", "ord"))
    chain = main.select("paper_id", F.lit("chain").alias("kind"), before.alias("source"), F.col("figure_id").alias("target"))
    extra = f.filter("extended").select("paper_id", "related", F.col("figure_id").alias("target"))
    hung = extra.join(main.select("paper_id", F.col("number").alias("related"), F.col("figure_id").alias("source")), ["paper_id", "related"], "left")
    return chain.unionByName(hung.select("paper_id", F.when(F.col("source").isNull(), "orphan").otherwise("branch").alias("kind"), "source", "target"))


def paper_tree(records: DataFrame, depth: int = 3) -> DataFrame:
    """Nodes of one tree a paper: paper_id, path, depth, text; the paper, its figures, panels and groups, as deep as asked."""
    nodes = tree(records).filter(F.col("depth") < depth)
    own = records.select("paper_id", "ord")
    below = nodes.join(own, "ord").select("paper_id", "path", (F.col("depth") + 1).alias("depth"), "text")
    top = records.groupBy("paper_id").agg(F.min_by("paper.title", "ord").alias("text"))
    return below.unionByName(top.select("paper_id", F.array().cast("array<bigint>").alias("path"), F.lit(0).alias("depth"), "text"))


def tree_layout(nodes: DataFrame) -> DataFrame:
    """Place of each node of a paper's drawn tree: x by depth; leaves take the next row, others lie half way between their first and last child."""
    up = F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))
    parents = nodes.filter("depth > 0").select("paper_id", up.alias("path")).distinct().withColumn("inner", F.lit(True))
    marked = nodes.join(parents, ["paper_id", "path"], "left")
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy("path"))
    leaves = marked.filter("inner IS NULL").select("paper_id", "path", "depth", "text", (TREE_TOP + (nth - 1) * TREE_ROW).cast("double").alias("y"))
    inner, placed = marked.filter("inner").drop("inner"), leaves
    level = leaves.filter("depth = 3")
    for d in (2, 1, 0):  # from the deepest parents up
        spans = level.groupBy("paper_id", up.alias("path")).agg(((F.min_by("y", "path") + F.max_by("y", "path")) / 2).alias("y"))
        own = inner.filter(F.col("depth") == d).join(spans, ["paper_id", "path"]).select("paper_id", "path", "depth", "text", "y")
        placed = placed.unionByName(own)
        level = own.unionByName(leaves.filter(F.col("depth") == d))
    return placed.withColumn("x", F.element_at(F.array(*map(F.lit, TREE_X)), F.col("depth") + 1))


def rail(records: DataFrame) -> DataFrame:
    """The list of a paper's figures: section, whether it begins there, the figure's short name, title and number of panels."""
    section = F.when(F.col("figure_id").startswith("Extended Data"), "Extended Data").otherwise("正文图")
    title = F.regexp_replace(F.coalesce("caption", F.lit("")), r"(?i)^(?:Extended Data\s+)?Fig(?:ure)?\.?\s*[0-9]+\s*[|.:]\s*", "")
    short = F.when(F.length(title) > RAIL_CHARS, F.concat(F.substring(title, 1, RAIL_CHARS), F.lit("…"))).otherwise(title)
    rows = records.select("paper_id", "ord", section.alias("section"), F.replace("figure_id", F.lit("Extended Data "), F.lit("ED ")).alias("name"), short.alias("title"), F.size("panels").alias("panels"))
    before = F.lag("section").over(Window.partitionBy("paper_id").orderBy("ord"))
    return rows.withColumn("begins", before.isNull() | (before != F.col("section")))


def asset_warnings(assets: DataFrame) -> DataFrame:
    """What assets(paper_id, figure_id, images, layout_route, bbox_confidence) are worth a look for: doubtful regions, figures without an image."""
    doubt = F.when(F.col("bbox_confidence") != "high", F.concat("figure_id", F.lit(" 切图置信度 "), "bbox_confidence", F.lit("（"), "layout_route", F.lit("）")))
    empty = F.when(F.coalesce(F.size("images"), F.lit(0)) <= 0, F.concat("figure_id", F.lit(" 没有产出任何切图")))
    return assets.select("paper_id", "figure_id", F.explode(F.array_compact(F.array(doubt, empty))).alias("warning"))


def readable_refs(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """Section marks in refs(paper_id, k, ref) replaced by short titles: Parent › Title, the parent if it has at most 12 characters and differs; unknown marks stay."""
    mark = F.regexp_extract("ref", r"^(§[0-9A-Z]+(?:\.[0-9]+)*)", 1)
    parent = F.regexp_replace(F.col("sid"), r"\.[^.]*$", "")
    r = refs.withColumn("sid", mark).withColumn("pid", F.regexp_replace(mark, r"\.[^.]*$", ""))
    named = sections.select("paper_id", F.col("id").alias("sid"), F.col("title").alias("own"))
    above = sections.select("paper_id", F.col("id").alias("pid"), F.col("title").alias("up"))
    x = r.join(named, ["paper_id", "sid"], "left").join(above, ["paper_id", "pid"], "left")
    short = F.when(F.length("own") > 30, F.concat(F.substring("own", 1, 29), F.lit("…"))).otherwise(F.col("own"))
    shown_up = F.col("up").isNotNull() & (F.length("up") <= 12) & (F.col("up") != F.col("own")) & (parent != F.col("sid"))
    return x.select("paper_id", "k", F.when(F.col("own").isNull(), F.col("ref")).otherwise(F.concat(F.when(shown_up, F.concat("up", F.lit(" › "))).otherwise(""), short, F.expr("substring(ref, length(sid) + 1)"))).alias("ref"))


def pending(reasons: DataFrame, records: DataFrame) -> DataFrame:
    """What is open about each figure: sentinel hits, inferred fields, low trust, then open questions."""
    rank = F.when(F.col("kind") == "sentinel", 0).when(F.col("kind") == "inferred", 1).otherwise(2)
    asked = records.select("paper_id", "figure_id", F.explode("open_questions").alias("text"), F.lit(3).alias("rank"))
    return reasons.select("paper_id", "figure_id", "text", rank.alias("rank")).unionByName(asked)


def api_messages(tasks: DataFrame) -> DataFrame:
    """Chat messages of tasks(paper_id, figure_id, doc, image binary) as JSON, images in base64; nothing is sent."""
    image = F.when(F.col("image").isNotNull(), F.concat(F.lit("data:image/png;base64,"), F.base64("image")))
    content = F.struct(F.col("doc").alias("text"), image.alias("image_url"))
    return tasks.select("paper_id", "figure_id", F.to_json(F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))).alias("messages"))


def extract(messages: DataFrame, extractor) -> DataFrame:
    """Raw records by a caller's extractor(iterator of pandas frames) -> frames with paper_id, figure_id, json; this library ships none."""
    return messages.mapInPandas(extractor, "paper_id string, figure_id string, json string")


def markmap_html(tree: dict) -> str:
    """A self-contained page of one nested tree; its JSON cannot close the script."""
    import json

    safe = json.dumps(tree, ensure_ascii=False)
    for c in "<>&":
        safe = safe.replace(c, f"\\u{ord(c):04x}")
    return f'<!doctype html><meta charset="utf-8"><title>map</title><ul id="t"></ul><script>const d={safe};const w=(n,e)=>{{const l=document.createElement("li");l.textContent=n.text;e.append(l);if(n.children){{const u=document.createElement("ul");l.append(u);n.children.forEach(c=>w(c,u))}}}};w(d,document.getElementById("t"))</script>'
