"""Page layout over primitive tables: lines, columns, headings, paragraphs, figure regions.

All frames carry paper_id and pno (page) and rectangles as x0, y0, x1, y1 with y downwards.
Windows are by paper or page, so papers spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions.exprs import area, norm_ws, overlap_1d

# Sizes in points and shares that layout decisions rest on.
LEAST_IMAGE, LEAST_DRAWING, RULE_HEIGHT, RULE_WIDTH, MOST_DRAWING = 20.0, 8.0, 3.0, 60.0, 0.92
RASTER_SHARE, MOST_RASTERS, FIGURE_CHARS, FIGURE_SHARE, GRAPHIC_SHARE = 0.10, 4, 600, 0.20, 0.015
CLUSTER_GAP, COVERAGE, MOST_BODY_LINES, LEAST_FIGURE, PAD = 34.0, 0.60, 2, 24.0, 4.0
BAND_LEAST, BAND_MOST, RULE_SHARE = 40.0, 0.80, 0.40
TABLE_BAND_LEAST, TABLE_BAND_MOST = 24.0, 0.85
PAGE = ["paper_id", "pno"]
ROUTES = ["journal_raster", "latex_vector", "fallback_band", "fallback_page"]
TRUST = ["high", "medium", "low"]


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def _area(prefix: str = "") -> Column:
    return area(*box(prefix))


# pages


def dedupe_images(images: DataFrame) -> DataFrame:
    """Images with both sides of 20 points or more, one for each set of whole corner coordinates."""
    large = images.filter((F.col("x1") - F.col("x0") >= LEAST_IMAGE) & (F.col("y1") - F.col("y0") >= LEAST_IMAGE))
    corners = [F.floor(c).cast("int").alias(f"c{i}") for i, c in enumerate(box())]
    return large.select("*", *corners).groupBy(*PAGE, "c0", "c1", "c2", "c3").agg(F.min(F.struct("x0", "y0", "x1", "y1")).alias("r")).select(*PAGE, "r.*")


def split_drawings(drawings: DataFrame, pages: DataFrame) -> DataFrame:
    """Drawings as rules (flat and wide) or graphics (8 points or more, below 92 % of the page); others go."""
    d = drawings.join(pages.select(*PAGE, (F.col("width") * F.col("height")).alias("page_area")), PAGE)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kind = F.when((h <= RULE_HEIGHT) & (w > RULE_WIDTH), "rule").when((w >= LEAST_DRAWING) & (h >= LEAST_DRAWING) & (w * h <= MOST_DRAWING * F.col("page_area")), "graphic")
    return d.withColumn("kind", kind).filter("kind IS NOT NULL").drop("page_area")


def page_facts(pages: DataFrame, images: DataFrame, graphics: DataFrame) -> DataFrame:
    """Each page's raster share, route, and whether it is a figure page or has graphics."""
    a = images.withColumn("a", _area()).groupBy(*PAGE).agg(F.sum("a").alias("raster"), F.max("a").alias("largest"), F.count("*").alias("n"))
    g = graphics.withColumn("a", _area()).groupBy(*PAGE).agg(F.sum("a").alias("drawn"))
    p = pages.join(a, PAGE, "left").join(g, PAGE, "left").fillna(0, ["raster", "largest", "n", "drawn"]).withColumn("page_area", F.col("width") * F.col("height"))
    share = F.col("raster") / F.col("page_area")
    route = F.when((F.col("largest") / F.col("page_area") >= RASTER_SHARE) & (F.col("n") <= MOST_RASTERS), ROUTES[0]).otherwise(ROUTES[1])
    figure = ((F.col("n_chars") < FIGURE_CHARS) & (share > RASTER_SHARE)) | (share > FIGURE_SHARE)
    graphic = (F.col("largest") >= GRAPHIC_SHARE * F.col("page_area")) | (F.col("drawn") >= GRAPHIC_SHARE * F.col("page_area"))
    return p.withColumn("route", route).withColumn("is_figure_page", figure).withColumn("has_graphics", graphic)


def neighbours(pages: DataFrame, step: int = 1) -> DataFrame:
    """The page before and after among the pages chosen, not by number."""
    w = Window.partitionBy("paper_id").orderBy("pno")
    return pages.withColumn("before", F.lag("pno", step).over(w)).withColumn("after", F.lead("pno", step).over(w))


def line_rects(words: DataFrame) -> DataFrame:
    """One rectangle a line from its words that are not blank."""
    return words.filter(F.trim("text") != "").groupBy(*PAGE, "block_no", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def page_lines(spans: DataFrame) -> DataFrame:
    """Lines from spans in reading order (column, rounded top, left): text, size, emphatic if all spans are bold."""
    s = spans.filter(F.trim("text") != "")
    bold = (F.col("flags").bitwiseAND(16) != 0) | F.col("font").rlike("(?i)bold|black|heavy|semibold")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda x: x["text"]), "")
    rows = s.groupBy(*PAGE, "col", "block_no", "line_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), norm_ws(text).alias("text"), F.round(F.max("size"), 1).alias("size"), F.bool_and(bold).alias("emphatic"))
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("col", F.round("y0", 1), "x0"))
    return rows.withColumn("ord", order)


# fonts, columns, bands


def body_size(lines: DataFrame) -> DataFrame:
    """Each paper's font size with most characters; ties go to the size met first."""
    w = lines.groupBy("paper_id", "size").agg(F.sum(F.length("text")).alias("chars"), F.min(F.struct("pno", "ord")).alias("first"))
    best = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("chars"), "first"))
    return w.withColumn("k", best).filter("k = 1").select("paper_id", F.col("size").alias("body"), "chars")


def doc_title(lines: DataFrame, body: DataFrame) -> DataFrame:
    """The first page's largest lines as one title, if they are a fifth larger than the body."""
    first = lines.withColumn("first", F.min("pno").over(Window.partitionBy("paper_id"))).filter("pno = first").withColumn("top", F.max("size").over(Window.partitionBy("paper_id")))
    large = first.join(body, "paper_id").filter((F.col("top") >= 1.2 * F.col("body")) & (F.col("size") >= F.col("top") - 0.2))
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", F.trim("text").alias("t"))))
    joined = F.regexp_replace(F.array_join(F.transform(parts, lambda x: x["t"]), " "), "- ", "-")
    return large.groupBy("paper_id").agg(F.substring(norm_ws(joined), 1, 400).alias("title"))


def column_edges(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Left and right edge of the column that rectangles form: the commonest left margin in bins of two points, and the nine-tenths largest right end of lines that begin there."""
    bins = rects.withColumn("bin", (F.col("x0") / 2.0).cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.min("x0").alias("left"))
    left = bins.groupBy(*keys).agg(F.max_by("left", F.struct("n", -F.col("bin"))).alias("left"))
    r = rects.join(left, keys)
    near = F.abs(F.col("x0") - F.col("left")) <= 4.0
    r = r.withColumn("aligned", F.sum(near.cast("int")).over(Window.partitionBy(*keys))).filter((F.col("aligned") < 4) | near)
    w = Window.partitionBy(*keys)
    r = r.withColumn("k", F.row_number().over(w.orderBy("x1")) - 1).withColumn("n", F.count("*").over(w))
    at = r.filter(F.col("k") == F.floor(0.90 * (F.col("n") - 1)))
    return at.select(*keys, "left", F.greatest(F.col("x1"), F.col("left") + 40.0).alias("right"))


def columns(rects: DataFrame, width: float) -> DataFrame:
    """Per page the columns 1 or 2 that its lines show, from sides and margins of the whole paper."""
    mid = (F.col("x0") + F.col("x1")) / 2
    narrow = rects.filter(F.col("x1") - F.col("x0") < 0.55 * width).withColumn("side", F.when(mid < width / 2, "left").otherwise("right"))
    n = narrow.groupBy("paper_id").agg(F.count(F.when(F.col("side") == "left", 1)).alias("l"), F.count(F.when(F.col("side") == "right", 1)).alias("r"))
    two = n.select("paper_id", ((F.least("l", "r") >= 30) & (F.least("l", "r") >= 0.2 * (F.col("l") + F.col("r")))).alias("two"))
    pages = narrow.groupBy(*PAGE).agg(F.count(F.when(F.col("side") == "left", 1)).alias("l"), F.count(F.when(F.col("side") == "right", 1)).alias("r"))
    return pages.join(two, "paper_id").select(*PAGE, F.when(F.col("two") & (F.col("l") >= 4) & (F.col("r") >= 4), 2).otherwise(1).alias("columns"))


def running_bands(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Top and bottom of each page's content: templates (digits alike) that repeat in the outer bands of a quarter of the pages are cut off, unless under 40 % would be left."""
    b = blocks.join(pages.select(*PAGE, "height"), PAGE).withColumn("template", F.substring(F.regexp_replace(norm_ws(F.col("text")), r"\d+", "#"), 1, 90))
    zone = F.when(F.col("y1") <= 0.085 * F.col("height"), "top").when(F.col("y0") >= 0.9 * F.col("height"), "bottom")
    b = b.withColumn("zone", zone).filter(F.col("zone").isNotNull() & (F.length(norm_ws(F.col("text"))).between(1, 160)))
    need = pages.groupBy("paper_id").agg(F.greatest(F.lit(3), F.floor(0.25 * F.count("*"))).alias("need"))
    often = b.groupBy("paper_id", "zone", "template").agg(F.countDistinct("pno").alias("on")).join(need, "paper_id").filter(F.col("on") >= F.col("need")).select("paper_id", "zone", "template")
    cut = b.join(often, ["paper_id", "zone", "template"]).groupBy(*PAGE).agg(F.max(F.when(F.col("zone") == "top", F.col("y1"))).alias("top"), F.min(F.when(F.col("zone") == "bottom", F.col("y0"))).alias("bottom"))
    out = pages.join(cut, PAGE, "left").withColumn("top", F.coalesce("top", F.lit(0.0))).withColumn("bottom", F.coalesce("bottom", F.col("height")))
    fine = F.col("bottom") - F.col("top") >= 0.4 * F.col("height")
    return out.select(*PAGE, F.when(fine, F.col("top")).otherwise(0.0).alias("top"), F.when(fine, F.col("bottom")).otherwise(F.col("height")).alias("bottom"))


# headings, sections, paragraphs


def bold_runs(lines: DataFrame, least: int = 3) -> DataFrame:
    """Marks lines in runs of ``least`` or more emphatic, column-filling lines of one column: body text set bold."""
    full = F.col("emphatic") & (F.col("x1") >= F.col("col_x1") - 0.02 * F.col("col_w"))
    w = Window.partitionBy(*PAGE).orderBy("ord")
    x = lines.withColumn("full", full).withColumn("change", (~F.col("full") | ~F.lag("full", 1, False).over(w) | (F.col("col") != F.lag("col").over(w))).cast("int"))
    x = x.withColumn("run", F.sum(F.coalesce("change", F.lit(1))).over(w))
    return x.withColumn("bold_run", F.col("full") & (F.sum(F.col("full").cast("int")).over(Window.partitionBy(*PAGE, "run")) >= least)).drop("full", "change", "run")


def run_in(lines: DataFrame) -> DataFrame:
    """Marks emphatic lines that plain text follows on the same baseline within three lines."""
    w = Window.partitionBy(*PAGE).orderBy("ord")

    def follows(k: int) -> Column:
        n = F.lead(F.struct("col", "y0", "x0", "emphatic"), k).over(w)
        return (n["col"] == F.col("col")) & (F.abs(n["y0"] - F.col("y0")) <= 2.0) & ~n["emphatic"] & n["x0"].between(F.col("x1") - 1, F.col("x1") + 30)

    any_of = F.coalesce(follows(1), F.lit(False)) | F.coalesce(follows(2), F.lit(False)) | F.coalesce(follows(3), F.lit(False))
    return lines.withColumn("runs_in", F.col("emphatic") & any_of)


SECTION_NUMBER = r"^\d{1,2}(\.\d{1,2})*\.?$|^[A-Z](\.\d{1,2})*\.?$"
NUMBERED = r"^((?:\d{1,2}|[A-Z])(?:\.\d{1,2})*)\.?\s+(\S.*)$"


def headings(lines: DataFrame, body: DataFrame) -> DataFrame:
    """Lines that look like headings (larger or bold, short, no list of authors, no number noise), wrapped ones joined in groups of at most three."""
    t, size = F.col("text"), F.col("size")
    x = lines.join(body.select("paper_id", "body"), "paper_id")
    letters, digits = F.length(F.regexp_replace(t, r"[^A-Za-zÀ-ɏ一-鿿]", "")), F.length(F.regexp_replace(t, r"[^0-9]", ""))
    plain = (letters >= 2) & (digits <= 0.5 * F.length(t)) & (~t.rlike(r"[.;,]$") | t.rlike(NUMBERED))
    ok = F.length(t).between(1, 120) & ~F.col("runs_in") & ~F.col("bold_run") & (F.col("emphatic") | (size >= F.col("body") + 1.5)) & (size >= F.col("body") - 0.3)
    ok = ok & ~F.contains(t, F.lit("&")) & (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) < 2) & (t.rlike(SECTION_NUMBER) | plain)
    w = Window.partitionBy("paper_id").orderBy("pno", "ord")
    x = x.withColumn("is_heading", F.coalesce(ok, F.lit(False)))
    before = F.lag(F.struct("is_heading", "pno", "col", "size", "y0", "y1")).over(w)
    joins = before["is_heading"] & (before["pno"] == F.col("pno")) & (before["col"] == F.col("col")) & (F.abs(before["size"] - size) <= 0.3) & (F.col("y0") - before["y1"] <= 1.5 * F.greatest(F.lit(1.0), before["y1"] - before["y0"])) & ~t.rlike(SECTION_NUMBER) & ~t.rlike(NUMBERED)
    x = x.withColumn("new", (F.col("is_heading") & ~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("group", F.sum("new").over(w)).filter("is_heading")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pno", "ord", "text"))), lambda p: p["text"])
    grouped = x.groupBy("paper_id", "group").agg(F.min(F.struct("pno", "ord")).alias("at"), norm_ws(F.array_join(parts, " ")).alias("title"), F.first("size").alias("size"), F.count("*").alias("n"))
    return grouped.filter((F.col("n") <= 3) & (F.length(F.regexp_replace("title", r"[^A-Za-zÀ-ɏ一-鿿]", "")) >= 2)).select("paper_id", "at.pno", "at.ord", "title", "size")


def _counters(x: DataFrame) -> DataFrame:
    """``counters`` of headings(paper_id, nth, depth, numbered_doc, ...): how many of each level down to ``depth`` came since the last heading above that level.

    A heading is a row for each of its levels and one for the level below, where it starts the count again.
    """
    level = F.when(F.col("numbered_doc"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("depth") + 1))
    each = x.select(F.struct(*[F.col(c) for c in x.columns]).alias("head"), "paper_id", "nth", "depth", F.explode(level).alias("of"))
    each = each.withColumn("part", F.sum((F.col("of") > F.col("depth")).cast("int")).over(Window.partitionBy("paper_id", "of").orderBy("nth")))
    each = each.withColumn("n", F.sum((F.col("of") == F.col("depth")).cast("int")).over(Window.partitionBy("paper_id", "of", "part").orderBy("nth")))
    own = F.when(F.col("of") <= F.col("depth"), F.struct("of", "n"))
    found = each.groupBy("paper_id", "nth").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(own)).alias("counts"))
    return found.select("head.*", F.transform("counts", lambda c: c["n"]).alias("counters"))


def sections(heads: DataFrame) -> DataFrame:
    """Sections of headings(paper_id, seq, title, size): id and level.

    Printed numbers are kept; other headings of a paper with numbers hang below the last
    one; a paper without numbers is numbered by the rank of its repeated font sizes, a
    level never jumping by more than one. A counter runs for every level down to a heading's own.
    A single line larger than all repeated sizes (a journal's name) is no section.
    """
    number = F.regexp_extract("title", NUMBERED, 1)
    x = heads.withColumn("number", F.nullif(number, F.lit("")))
    p = Window.partitionBy("paper_id")
    x = x.withColumn("numbered_doc", F.count("number").over(p) >= 0.4 * F.count("*").over(p))
    x = x.withColumn("of_size", F.count("*").over(Window.partitionBy("paper_id", "size")))
    x = x.withColumn("any_repeat", F.max(F.col("of_size") >= 2).over(p)).withColumn("base", F.when((F.col("of_size") >= 2) | ~F.col("any_repeat"), F.col("size")))
    x = x.withColumn("biggest", F.max("base").over(p)).filter("base IS NOT NULL OR size IS NULL OR biggest IS NULL OR size <= biggest")
    x = x.withColumn("level_of", F.when(F.col("base").isNotNull(), F.dense_rank().over(p.orderBy(F.desc_nulls_last("base")))).otherwise(1))
    order = p.orderBy("seq")
    x = x.withColumn("nth", F.row_number().over(order))
    # one level below the heading before at most: its place, unless a shorter way leads from a heading before
    x = x.withColumn("depth", F.col("nth") + F.least(F.lit(0), F.min(F.col("level_of") - F.col("nth")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    x = _counters(x)
    x = x.withColumn("last", F.last("number", True).over(order)).withColumn("block", F.count("number").over(order))
    x = x.withColumn("sub", F.row_number().over(Window.partitionBy("paper_id", "block").orderBy("seq")) - F.when(F.col("block") > 0, 1).otherwise(0))
    sid = F.when(F.col("number").isNotNull(), F.col("number")).when(F.col("numbered_doc"), F.concat(F.coalesce("last", F.lit("0")), F.lit("."), F.col("sub").cast("string"))).otherwise(F.array_join(F.col("counters").cast("array<string>"), "."))
    x = x.withColumn("id", F.concat(F.lit("§"), sid)).withColumn("level", F.size(F.split("id", r"\.")))
    nth = F.row_number().over(Window.partitionBy("paper_id", "id").orderBy("seq"))
    title = F.when(F.col("number").isNotNull(), F.regexp_extract("title", NUMBERED, 2)).otherwise(F.col("title"))
    return x.select("paper_id", "seq", F.when(nth > 1, F.concat("id", F.lit("#"), nth.cast("string"))).otherwise(F.col("id")).alias("id"), title.alias("title"), "level")


METHODS_STRONG = r"(?iu)^(materials?\s+and\s+)?methods?\b|methods?$|experimental\s+(setup|settings?|procedures?)|材料与方法|实验方法"
METHODS_WEAK = r"(?iu)implementation details|training details|statistic|datasets?$"


def mark_methods(secs: DataFrame) -> DataFrame:
    """Strong titles mark their section and all below it; weak ones only their own."""
    strong = F.col("title").rlike(METHODS_STRONG)
    x = secs.filter("paper_id IS NOT NULL AND seq IS NOT NULL").select("paper_id", "seq", "level", F.coalesce(strong, F.lit(False)).alias("strong"))
    # a strong section reaches to the next section of its level or above, without a level to the end
    of = x.filter("strong").select("paper_id", F.col("level").alias("of")).distinct()
    met = x.join(of, "paper_id").withColumn("starts", F.col("strong") & F.col("level").eqNullSafe(F.col("of"))).filter("level <= of OR starts")
    met = met.groupBy("paper_id", "of", "seq").agg(F.max("starts").alias("starts"))
    spans = met.withColumn("to_seq", F.lead("seq").over(Window.partitionBy("paper_id", "of").orderBy("seq"))).filter("starts")
    steps = spans.select("paper_id", "seq", F.lit(1).alias("step")).unionAll(spans.filter("to_seq IS NOT NULL").select("paper_id", F.col("to_seq").alias("seq"), F.lit(-1).alias("step")))
    steps = x.select("paper_id", "seq", F.lit(0).alias("step")).unionAll(steps).groupBy("paper_id", "seq").agg(F.sum("step").alias("step"))
    under = F.sum("step").over(Window.partitionBy("paper_id").orderBy("seq")) > 0
    inside = steps.select("paper_id", "seq", under.alias("under"))
    return secs.join(inside, ["paper_id", "seq"], "left").withColumn("is_methods", F.coalesce("under", F.lit(False)) | F.col("title").rlike(METHODS_WEAK)).drop("under")


def paragraphs(lines: DataFrame) -> DataFrame:
    """Paragraphs of lines(paper_id, section_id, pno, ord, col, x0, y0, x1, y1, col_x1, col_w, text), numbered in their section.

    A line begins one at a change of page or column, an indent, a wide gap, or after a
    short line; never on the same baseline. Texts under two characters take no number.
    """
    w = Window.partitionBy("paper_id", "section_id").orderBy("pno", "ord")
    before = F.lag(F.struct("pno", "col", "x0", "y0", "x1", "y1", "col_x1", "col_w")).over(w)
    short = before["x1"] < before["col_x1"] - 0.10 * before["col_w"]
    gap = F.col("y0") - before["y1"] > 1.2 * (before["y1"] - before["y0"])
    new = F.when(before.isNull(), True).when((before["pno"] != F.col("pno")) | (before["col"] != F.col("col")), True).when(F.abs(before["y0"] - F.col("y0")) <= 2.0, False).otherwise(short | (F.col("x0") - before["x0"] > 4) | gap)
    x = lines.withColumn("part", F.sum(new.cast("int")).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pno", "ord", "text"))), lambda p: p["text"])
    text = F.regexp_replace(norm_ws(F.array_join(parts, " ")), r"(?<=[A-Za-z])- (?=[a-z])", "")
    x = x.groupBy("paper_id", "section_id", "part").agg(F.min("pno").alias("page"), F.min(F.struct("pno", "ord")).alias("at"), text.alias("text")).filter(F.length("text") >= 2)
    n = F.row_number().over(Window.partitionBy("paper_id", "section_id").orderBy("at"))
    return x.select("paper_id", "section_id", F.concat("section_id", F.lit("¶"), n.cast("string")).alias("id"), "page", "text")


# figure regions


def clusters(rects: DataFrame, keys: list[str], gap: float = CLUSTER_GAP) -> DataFrame:
    """Rectangles in groups from top to bottom, a new one where the gap below all before exceeds ``gap``."""
    w = Window.partitionBy(*keys).orderBy("y0", "x0", "x1", "y1")
    low = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = rects.withColumn("new", F.coalesce((F.col("y0") - low > gap).cast("int"), F.lit(0))).withColumn("cluster", F.sum("new").over(w))
    return x.groupBy(*keys, "cluster").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def shares_column(x0: Column, x1: Column, c0: Column, c1: Column) -> Column:
    narrow = F.least(x1 - x0, c1 - c0)
    return (narrow > 0) & (overlap_1d(x0, x1, c0, c1) > 0.30 * narrow)


def caption_column(anchors: DataFrame, page_columns: DataFrame, content: DataFrame) -> DataFrame:
    """The column of each caption: the whole content for wide ones, else the first whose edges hold its middle (within 6 points), else the content."""
    a = anchors.join(content.select(*PAGE, "content_x0", "content_x1"), PAGE)
    mid = (F.col("x0") + F.col("x1")) / 2
    c = page_columns.select(*PAGE, "column_no", "c0", "c1")
    hit = a.join(c, PAGE, "left").filter(F.col("c0").isNotNull() & mid.between(F.col("c0") - 6, F.col("c1") + 6)).groupBy(*PAGE, "anchor_id").agg(F.min_by(F.struct("c0", "c1"), "column_no").alias("c"))
    a = a.join(hit, [*PAGE, "anchor_id"], "left")
    wide = (F.col("content_x1") > F.col("content_x0")) & (F.col("x1") - F.col("x0") >= 0.66 * (F.col("content_x1") - F.col("content_x0")))
    return a.withColumn("col_x0", F.when(wide | F.col("c").isNull(), F.col("content_x0")).otherwise(F.col("c.c0"))).withColumn("col_x1", F.when(wide | F.col("c").isNull(), F.col("content_x1")).otherwise(F.col("c.c1"))).drop("c", "content_x0", "content_x1")


def ceiling_floor(anchors: DataFrame, content: DataFrame) -> DataFrame:
    """How far each caption's region reaches: the nearest caption above and below in its column, else the content's edges.

    Captions of a page are few, so the join within a page is small whatever the corpus.
    """
    other = anchors.select(*PAGE, F.col("anchor_id").alias("o"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    met = anchors.join(other, PAGE).filter((F.col("o") != F.col("anchor_id")) & shares_column(F.col("o_x0"), F.col("o_x1"), F.col("col_x0"), F.col("col_x1")))
    near = met.groupBy(*PAGE, "anchor_id").agg(F.max(F.when(F.col("o_y1") <= F.col("y0") + 1, F.col("o_y1"))).alias("above"), F.min(F.when(F.col("o_y0") >= F.col("y1") - 1, F.col("o_y0"))).alias("below"))
    x = anchors.join(near, [*PAGE, "anchor_id"], "left").join(content.select(*PAGE, "content_top", "content_bottom"), PAGE)
    return x.withColumn("ceiling", F.greatest("content_top", F.coalesce("above", F.col("content_top")))).withColumn("floor", F.least("content_bottom", F.coalesce("below", F.col("content_bottom")))).drop("above", "below", "content_top", "content_bottom")


def effective_column(anchors: DataFrame, graphics: DataFrame, content: DataFrame) -> DataFrame:
    """Widens a caption's column to the content where graphics below its ceiling reach over it by 24 points and no other figure's caption stands beside it."""
    g = anchors.join(graphics.select(*PAGE, *[c.alias(f"g_{n}") for c, n in zip(box(), ("x0", "y0", "x1", "y1"), strict=True)]), PAGE).filter((F.col("g_y1") > F.col("ceiling")) & (F.col("g_y1") <= F.col("y0") + 2))
    reach = g.groupBy(*PAGE, "anchor_id").agg(F.min("g_x0").alias("r0"), F.max("g_x1").alias("r1"))
    other = anchors.filter("kind = 'figure'").select(*PAGE, F.col("anchor_id").alias("o"), ((F.col("x0") + F.col("x1")) / 2).alias("o_mid"), F.col("y0").alias("o_y0"))
    beside = anchors.join(other, PAGE).filter("o <> anchor_id AND o_y0 > ceiling AND NOT (o_mid >= col_x0 AND o_mid < col_x1)").select(*PAGE, "anchor_id").distinct().withColumn("beside", F.lit(True))
    x = anchors.join(reach, [*PAGE, "anchor_id"], "left").join(beside, [*PAGE, "anchor_id"], "left").join(content.select(*PAGE, "content_x0", "content_x1"), PAGE)
    over = F.coalesce((F.col("r0") < F.col("col_x0") - 24) | (F.col("r1") > F.col("col_x1") + 24), F.lit(False)) & F.col("beside").isNull()
    return x.withColumn("col_x0", F.when(over, F.col("content_x0")).otherwise(F.col("col_x0"))).withColumn("col_x1", F.when(over, F.col("content_x1")).otherwise(F.col("col_x1"))).drop("r0", "r1", "beside", "content_x0", "content_x1")


def candidates(anchors: DataFrame, graphics: DataFrame) -> DataFrame:
    """Graphics above a caption, below its ceiling and in its column."""
    g = anchors.select(*PAGE, "anchor_id", F.col("y0").alias("cap_y0"), "ceiling", "col_x0", "col_x1").join(graphics.select(*PAGE, "x0", "y0", "x1", "y1"), PAGE)
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("col_x1") - F.col("col_x0"))
    return g.filter((F.col("y1") <= F.col("cap_y0") + 2) & (F.col("y1") > F.col("ceiling") + 2) & (overlap_1d(F.col("x0"), F.col("x1"), F.col("col_x0"), F.col("col_x1")) > 0.25 * narrow))


def body_lines(gaps: DataFrame, texts: DataFrame, graphics: DataFrame, keys: list[str]) -> DataFrame:
    """Wide text lines inside each gap that lie on no graphic: keys, n. gaps(keys, page, x0..y1, col_x0, col_x1)."""
    on = PAGE
    t = texts.select(*on, *[c.alias(f"t_{n}") for c, n in zip(box(), ("x0", "y0", "x1", "y1"), strict=True)]).withColumn("t_id", F.monotonically_increasing_id())
    w, h = F.greatest(F.lit(1.0), F.col("t_x1") - F.col("t_x0")), F.greatest(F.lit(1.0), F.col("t_y1") - F.col("t_y0"))
    inside = gaps.join(t, on).filter((F.col("t_x1") - F.col("t_x0") >= 0.40 * F.greatest(F.lit(1.0), F.col("col_x1") - F.col("col_x0"))) & (overlap_1d(F.col("t_y0"), F.col("t_y1"), F.col("y0"), F.col("y1")) > 0.6 * h) & (overlap_1d(F.col("t_x0"), F.col("t_x1"), F.col("x0"), F.col("x1")) > 0.5 * w))
    g = graphics.select(*keys, *[c.alias(f"g_{n}") for c, n in zip(box(), ("x0", "y0", "x1", "y1"), strict=True)])
    under = inside.join(g, keys).filter((overlap_1d(F.col("t_x0"), F.col("t_x1"), F.col("g_x0"), F.col("g_x1")) > 0.5 * w) & (overlap_1d(F.col("t_y0"), F.col("t_y1"), F.col("g_y0"), F.col("g_y1")) > 0.5 * h)).select(*keys, "cluster", "t_id").distinct()
    return inside.join(under, [*keys, "cluster", "t_id"], "left_anti").groupBy(*keys, "cluster").agg(F.count("*").alias("lines"))


def graphics_bbox(anchors: DataFrame, graphics: DataFrame, texts: DataFrame) -> DataFrame:
    """Each caption's figure: clusters of candidates from the lowest up, as long as no gap holds more than two body lines; its share of all candidates."""
    keys = [*PAGE, "anchor_id"]
    c = candidates(anchors, graphics)
    g = clusters(c, keys)
    w = Window.partitionBy(*keys)
    up = w.orderBy(F.desc("cluster"))
    g = g.withColumn("below_y0", F.min("y0").over(up.rowsBetween(Window.unboundedPreceding, -1))).withColumn("full_x0", F.min("x0").over(w)).withColumn("full_x1", F.max("x1").over(w)).withColumn("full_y0", F.min("y0").over(w)).withColumn("full_y1", F.max("y1").over(w))
    span = anchors.select(*keys, "col_x0", "col_x1", F.col("y0").alias("cap_y0"), "ceiling")
    gaps = g.filter("below_y0 IS NOT NULL AND below_y0 > y1").join(span, keys).select(*keys, "cluster", F.col("full_x0").alias("x0"), F.col("y1").alias("y0"), F.col("full_x1").alias("x1"), F.col("below_y0").alias("y1"), "col_x0", "col_x1")
    blocked = body_lines(gaps, texts, c, keys)
    g = g.join(blocked, [*keys, "cluster"], "left").withColumn("stop", F.sum((F.coalesce("lines", F.lit(0)) > MOST_BODY_LINES).cast("int")).over(up)).filter("stop = 0")
    out = g.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.first(area(F.col("full_x0"), F.col("full_y0"), F.col("full_x1"), F.col("full_y1"))).alias("full")).join(span, keys)
    out = out.withColumn("coverage", _area() / F.when(F.col("full") > 0, F.col("full")).otherwise(1.0))
    out = out.withColumn("y0", F.greatest("y0", "ceiling")).withColumn("y1", F.least("y1", "cap_y0")).withColumn("x0", F.greatest(F.col("x0"), F.col("col_x0") - 12)).withColumn("x1", F.least(F.col("x1"), F.col("col_x1") + 12))
    return out.filter((F.col("x1") - F.col("x0") >= LEAST_FIGURE) & (F.col("y1") - F.col("y0") >= LEAST_FIGURE)).drop("full")


def absorb_text(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """Regions grown by text of which over 60 % lies within 14 points of them, between ceiling and caption, in the column."""
    keys = [*PAGE, "anchor_id"]
    t = texts.select(*PAGE, *[c.alias(f"t_{n}") for c, n in zip(box(), ("x0", "y0", "x1", "y1"), strict=True)])
    tx, ty = (F.col("t_x0"), F.col("t_x1")), (F.col("t_y0"), F.col("t_y1"))
    inter = overlap_1d(*tx, F.col("x0") - 14, F.col("x1") + 14) * overlap_1d(*ty, F.col("y0") - 14, F.col("y1") + 14)
    near = regions.join(t, PAGE).filter((F.col("t_y0") >= F.col("ceiling") - 1) & (F.col("t_y1") <= F.col("cap_y0") + 1) & (overlap_1d(*tx, F.col("col_x0"), F.col("col_x1")) > 0) & (_area("t_") > 0) & (inter > 0.60 * _area("t_")))
    grown = near.groupBy(*keys).agg(F.min("t_x0").alias("a0"), F.min("t_y0").alias("b0"), F.max("t_x1").alias("a1"), F.max("t_y1").alias("b1"))
    x = regions.join(grown, keys, "left")
    x = x.withColumn("x0", F.greatest(F.least(F.col("x0"), F.coalesce("a0", "x0")), F.col("col_x0") - 12)).withColumn("x1", F.least(F.greatest(F.col("x1"), F.coalesce("a1", "x1")), F.col("col_x1") + 12))
    return x.withColumn("y0", F.greatest(F.least(F.col("y0"), F.coalesce("b0", "y0")), F.col("ceiling"))).withColumn("y1", F.least(F.greatest(F.col("y1"), F.coalesce("b1", "y1")), F.col("cap_y0"))).drop("a0", "b0", "a1", "b1")


def finalize(regions: DataFrame, content: DataFrame, pad: float = PAD) -> DataFrame:
    """Padding first, then the limits ceiling, caption and column (12 points), the content band and the page; two decimals."""
    x = regions.join(content.select(*PAGE, "content_top", "content_bottom", "width", "height"), PAGE)
    x0 = F.greatest(F.col("x0") - pad, F.col("col_x0") - 12, F.lit(0.0))
    x1 = F.least(F.col("x1") + pad, F.col("col_x1") + 12, F.col("width"))
    y0 = F.greatest(F.col("y0") - pad, F.col("ceiling"), F.col("content_top"), F.lit(0.0))
    y1 = F.least(F.col("y1") + pad, F.col("cap_y0"), F.col("content_bottom"), F.col("height"))
    return x.withColumns({"x0": F.bround(x0, 2), "y0": F.bround(y0, 2), "x1": F.bround(x1, 2), "y1": F.bround(y1, 2)}).drop("content_top", "content_bottom", "width", "height")


def caption_only(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """Captions on pages without graphics whose figure has another caption on a page with some."""
    a = anchors.join(facts.select(*PAGE, "has_graphics"), PAGE)
    key = ["paper_id", "kind", "series", "number"]
    return a.filter("NOT has_graphics").join(a.filter("has_graphics").select(*key), key, "left_semi")


def number_order(placements: DataFrame) -> DataFrame:
    """Marks figures whose page lies before one of a smaller number in their series."""
    w = Window.partitionBy("paper_id", "series").orderBy("n", "anchor_id").rowsBetween(Window.unboundedPreceding, -1)
    return placements.withColumn("out_of_order", F.coalesce(F.col("pno") < F.max("pno").over(w), F.lit(False)))


def emit_assets(placements: DataFrame) -> DataFrame:
    """One asset a figure from its parts, in page order: pages, images with part suffix, the worst route and trust, the joined caption.

    Parts that only give their caption have no image. The first caption that is no
    reference to another page leads; others add what they say beyond 20 characters.
    """
    from figmill.functions.text import SEE_OTHER_PAGE

    rank = lambda c, values: F.array_position(F.array(*map(F.lit, values)), c)
    part = F.struct("pno", "y0", "caption", "text_only", rank(F.col("route"), ROUTES).alias("route"), rank(F.col("trust"), TRUST).alias("trust"))
    g = placements.groupBy("paper_id", "series", "number").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    shown = F.filter("parts", lambda p: ~p["text_only"])
    worst = lambda f, values: F.coalesce(F.element_at(F.array(*map(F.lit, values)), F.nullif(F.array_max(F.transform(shown, lambda p: p[f])), F.lit(0)).cast("int")), F.lit(values[-1]))
    captions = F.transform("parts", lambda p: p["caption"])
    own = F.filter(captions, lambda c: ~c.rlike(SEE_OTHER_PAGE))
    lead = F.coalesce(F.get(own, F.lit(0)), F.get(captions, F.lit(0)))
    more = F.filter(F.slice(own, F.lit(2), F.greatest(F.lit(0), F.size(own) - 1)), lambda c: F.length(c) > 20)
    suffix = lambda i: F.when(F.size(shown) > 1, F.concat(F.lit("_"), F.char(97 + i))).otherwise("")
    return g.select(
        "paper_id", "series", "number",
        F.array_sort(F.array_distinct(F.transform("parts", lambda p: p["pno"]))).alias("pages"),
        F.transform(shown, lambda p, i: F.concat(F.lit("fig_"), F.lpad("number", 2, "0"), suffix(i), F.lit(".png"))).alias("images"),
        worst("route", ROUTES).alias("route"), worst("trust", TRUST).alias("trust"), F.array_join(F.concat(F.array(lead), more), " ").alias("caption"),
    )


def sort_assets(assets: DataFrame) -> DataFrame:
    """Place of each asset: figures first, by number (none last), then text, then order found."""
    w = Window.partitionBy("paper_id").orderBy((F.col("kind") == "table").cast("int"), F.coalesce(F.col("number").try_cast("int"), F.lit(999)), "number", "ord")
    return assets.withColumn("place", F.row_number().over(w))


# tables


def rules_in(bands: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules inside bands(page, band_id, x0..y1, col_x0, col_x1) that span over 40 % of the column."""
    r = rules.select(*PAGE, *[c.alias(f"r_{n}") for c, n in zip(box(), ("x0", "y0", "x1", "y1"), strict=True)])
    width = F.greatest(F.lit(1.0), F.col("col_x1") - F.col("col_x0"))
    return bands.join(r, PAGE).filter((F.col("r_y0") >= F.col("y0") - 2) & (F.col("r_y1") <= F.col("y1") + 2) & (overlap_1d(F.col("r_x0"), F.col("r_x1"), F.col("col_x0"), F.col("col_x1")) > RULE_SHARE * width))


def side_vote(gaps: DataFrame) -> DataFrame:
    """Whether a paper's captions stand below ('above' votes) or above their tables, from gaps(paper_id, up, down) to the nearest rule; null where there is none; ties count as above."""
    up, down = F.col("up"), F.col("down")
    above = up.isNotNull() & (down.isNull() | (up <= down))
    below = down.isNotNull() & ~above
    v = gaps.groupBy("paper_id").agg(F.count(F.when(above, 1)).alias("above"), F.count(F.when(below, 1)).alias("below"))
    return v.withColumn("side", F.when((F.col("above") == 0) & (F.col("below") == 0), None).when(F.col("above") >= F.col("below"), "above").otherwise("below"))


NUMERIC = r"^[-+−–]?[\d.,]+%?[*†‡]*$"


def band_score(bands: DataFrame, rules: DataFrame, words: DataFrame) -> DataFrame:
    """How much a band looks like a table: 3 a rule, 12 times the share of numbers, 0.4 a text row (25 at most)."""
    keys = [*PAGE, "band_id"]
    n = rules_in(bands, rules).groupBy(*keys).agg(F.count("*").alias("rules"))
    w = words.select(*PAGE, "text", ((F.col("x0") + F.col("x1")) / 2).alias("w_x"), ((F.col("y0") + F.col("y1")) / 2).alias("w_y"), F.bround(F.col("y0") / 4, 0).alias("row"))
    inside = bands.join(w, PAGE).filter(F.col("w_y").between(F.col("y0") - 1, F.col("y1") + 1) & F.col("w_x").between(F.col("col_x0") - 12, F.col("col_x1") + 12))
    t = inside.groupBy(*keys).agg(F.count("*").alias("words"), F.count(F.when(F.col("text").rlike(NUMERIC), 1)).alias("numbers"), F.countDistinct("row").alias("rows"))
    x = bands.join(n, keys, "left").join(t, keys, "left").fillna(0, ["rules", "words", "numbers", "rows"])
    return x.withColumn("score", 3.0 * F.col("rules") + 12.0 * F.when(F.col("words") > 0, F.col("numbers") / F.col("words")).otherwise(0.0) + 0.4 * F.least(F.col("rows"), F.lit(25)))


def band_is_sane(height: Column, width: Column, page_height: Column) -> Column:
    return (height >= TABLE_BAND_LEAST) & (height <= TABLE_BAND_MOST * page_height) & (width > 20)


def column_bounds(words: DataFrame, boxes: DataFrame, most: int = 40) -> DataFrame:
    """Column cuts of a table: middles of the inner channels of two points or more that at most a quarter of its rows cross.

    words(table_id, row, x0, x1), boxes(table_id, x0, x1). The widest channels stay if there are too many.
    """
    b = boxes.select("table_id", F.col("x0").alias("b0"), F.greatest(F.lit(1), (F.col("x1") - F.col("x0")).cast("int") + 2).alias("n"))
    w = words.join(b, "table_id")
    first, last = F.greatest(F.lit(0), (F.col("x0") - F.col("b0")).cast("int")), F.least(F.col("n") - 1, (F.col("x1") - F.col("b0")).cast("int"))
    cover = w.filter(first <= last).select("table_id", "row", F.explode(F.sequence(first, last)).alias("at")).distinct().groupBy("table_id", "at").agg(F.count("*").alias("c"))
    rows = words.groupBy("table_id").agg(F.greatest(F.lit(1), F.floor(0.25 * F.countDistinct("row"))).alias("most_rows"))
    grid = b.select("table_id", "b0", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at")).join(cover, ["table_id", "at"], "left").join(rows, "table_id")
    free = grid.filter(F.coalesce("c", F.lit(0)) <= F.col("most_rows")).withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("table_id").orderBy("at")))
    runs = free.groupBy("table_id", "run", "b0", "n").agg(F.min("at").alias("a"), (F.max("at") + 1).alias("z")).filter("a > 0 AND z < n AND z - a >= 2")
    runs = runs.withColumn("k", F.row_number().over(Window.partitionBy("table_id").orderBy(F.desc(F.col("z") - F.col("a")), "a"))).filter(F.col("k") <= most - 1)
    cuts = runs.groupBy("table_id").agg(F.array_sort(F.collect_list(F.col("b0") + (F.col("a") + F.col("z")) / 2)).alias("cuts"))
    return boxes.join(cuts, "table_id", "left").select("table_id", F.concat(F.array(F.col("x0") - 1), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.col("x1") + 1)).alias("bounds"))


def text_grid(words: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cells of words(table_id, row, x0, x1, text) by the bounds their middles fall in: table_id, row, cells; blank rows go."""
    w = words.join(bounds, "table_id").withColumn("mid", (F.col("x0") + F.col("x1")) / 2)
    cell = F.size(F.filter("bounds", lambda b: b <= F.col("mid"))) - 1
    w = w.withColumn("cell", F.greatest(F.lit(0), F.least(F.size("bounds") - 2, cell)))
    text = F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"])
    cells = w.groupBy("table_id", "row", "cell", F.size("bounds").alias("n")).agg(norm_ws(F.array_join(text, " ")).alias("t"))
    rows = cells.groupBy("table_id", "row", "n").agg(F.map_from_entries(F.collect_list(F.struct("cell", "t"))).alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.coalesce(F.get(F.array(F.element_at("m", i)), F.lit(0)), F.lit("")))
    return rows.select("table_id", "row", line.alias("cells")).filter(F.exists("cells", lambda c: c != ""))


def merge_tables(assets: DataFrame) -> DataFrame:
    """Tables with one number as one: pages together, grids one after the other, in order found."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "pages", "grid")))
    g = assets.groupBy("paper_id", "number").agg(parts.alias("p"))
    return g.select("paper_id", "number", F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: x["pages"])))).alias("pages"), F.flatten(F.transform("p", lambda x: x["grid"])).alias("grid"))


def nearest_gap(bands: DataFrame, rules: DataFrame) -> DataFrame:
    """Gap between each band's caption side and its nearest rule: band_id, gap; none without a rule. bands have side ('above': the band lies above its caption)."""
    met = rules_in(bands, rules)
    gap = F.when(F.first("side") == "above", F.first("y1") - F.max("r_y1")).otherwise(F.min("r_y0") - F.first("y0"))
    return met.groupBy(*PAGE, "band_id").agg(gap.alias("gap"))


def choose_band(bands: DataFrame, rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Each table's region: a sane band drawn in to its rules (8 points beyond, 6 at the sides) with high trust, the band without rules with medium, the page with low."""
    met = rules_in(bands, rules).groupBy(*PAGE, "band_id").agg(F.min("r_x0").alias("a0"), F.min("r_y0").alias("b0"), F.max("r_x1").alias("a1"), F.max("r_y1").alias("b1"))
    x = bands.join(met, [*PAGE, "band_id"], "left").join(pages.select(*PAGE, "width", "height"), PAGE)
    sane = band_is_sane(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"), F.col("height"))
    ruled = F.col("a0").isNotNull()
    trust = F.when(~sane, "low").when(ruled, "high").otherwise("medium")
    pick = lambda page, band, tight: F.when(~sane, page).when(ruled, tight).otherwise(band)
    above = F.col("side") == "above"
    return x.select(
        *PAGE, "band_id", trust.alias("trust"),
        pick(F.lit(0.0), F.col("x0"), F.least(F.col("a0") - 6, F.col("x0"))).alias("x0"),
        pick(F.lit(0.0), F.col("y0"), F.when(above, F.greatest(F.col("y0"), F.col("b0") - 8)).otherwise(F.col("y0"))).alias("y0"),
        pick(F.col("width"), F.col("x1"), F.greatest(F.col("a1") + 6, F.col("x1"))).alias("x1"),
        pick(F.col("height"), F.col("y1"), F.when(above, F.col("y1")).otherwise(F.least(F.col("y1"), F.col("b1") + 8))).alias("y1"),
    )


def assign_rows(words: DataFrame, most: int = 250) -> DataFrame:
    """Text rows of words(table_id, x0, y0, x1, y1, text): a word joins the row before if its middle lies within the tolerance of that row's mean middle.

    The mean moves with every word, so a table is read in order; tables are read in parallel.
    """
    import pandas as pd

    def read(w: pd.DataFrame) -> pd.DataFrame:
        w = w[w["text"].str.strip() != ""].copy()
        tall = (w["y1"] - w["y0"])[w["y1"] > w["y0"]]
        near = max(2.0, 0.55 * (float(tall.median()) if len(tall) else 10.0))
        w["mid"] = (w["y0"] + w["y1"]) / 2
        w = w.sort_values(["mid", "x0"], kind="stable")
        rows, total, count = [], 0.0, 0
        for mid in w["mid"]:
            if count and abs(mid - total / count) <= near:
                total, count = total + mid, count + 1
                rows.append(rows[-1])
            else:
                total, count = mid, 1
                rows.append(rows[-1] + 1 if rows else 0)
        w["row"] = rows
        return w[w["row"] < most][["table_id", "row", "x0", "x1", "text"]]

    return words.select("table_id", "x0", "y0", "x1", "y1", "text").groupBy("table_id").applyInPandas(read, "table_id long, row long, x0 double, x1 double, text string")
