"""Extraction tasks and labels: numbered sections, formats, choice of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions.text import figure_selected, record_slug

#: How trust is shown.
TRUST = {"high": "高", "medium": "中", "low": "低"}


def numbered(sections: DataFrame, dropped: dict[str, list[str]], bodies: bool = False) -> DataFrame:
    """Sections(ord, k, key, body, level) as one numbered document a task.

    Empty sections and those that a level drops, by key, take no number. ``bodies``:
    with their texts.
    """
    keep = F.col("body") != ""
    for level, keys in dropped.items():
        keep = keep & ~((F.col("level") == level) & F.col("key").isin(keys))
    n = F.row_number().over(Window.partitionBy("ord").orderBy("k"))
    lines = sections.filter(keep).withColumn("n", n).withColumn("line", F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), "key", *([F.lit("\n\n"), F.col("body"), F.lit("\n")] if bodies else [])))
    ordered = F.array_sort(F.collect_list(F.struct("n", "line")))
    return lines.groupBy("ord").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("doc"))


# The sections of a task in order, and those that levels leave out.
SECTIONS = ["Figure", "Caption", "Panels", "Cited in", "Methods", "Skeleton", "Check"]
LEVELS = {"full": [], "standard": ["Check"], "light": ["Methods", "Check"]}


def skeleton(figure_id: Column, caption: Column, labels: Column) -> Column:
    """A record to fill in, as JSON: the panels are named, all else is not reported."""
    none = F.lit("not_reported")
    empty = F.array().cast("array<string>")
    text = lambda *names: F.struct(*[none.alias(n) for n in names])
    panel = lambda x: F.struct(x.alias("label"), none.alias("experiment"), F.struct(none.alias("independent_var"), empty.alias("levels"), empty.alias("controlled"), none.alias("unit")).alias("design"), F.array(F.struct(none.alias("name"), F.lit("reference").alias("role"), *[none.alias(n) for n in ("condition", "n", "readout", "result", "vs_control")])).alias("groups"), text("test", "error_bar", "replicates", "significance").alias("stats"), none.alias("finding"), F.struct(*[empty.alias(n) for n in ("from_caption", "from_body", "from_methods", "from_image_only", "inferred")]).alias("evidence"))
    return F.to_json(F.struct(F.lit("1.0").alias("schema_version"), figure_id.alias("figure_id"), F.lit("figure").alias("kind"), caption.alias("caption"), none.alias("question"), F.transform(labels, panel).alias("panels"), none.alias("figure_conclusion"), F.lit("medium").alias("confidence"), empty.alias("open_questions")))


def build(packs: DataFrame, level: str = "full", figures: str = "") -> DataFrame:
    """One task a context pack: paper_id, figure_id, slug, doc. ``figures`` selects as text.figure_selected says.

    Raises ValueError for an unknown level, or if nothing is selected.
    """
    if level not in LEVELS:
        raise ValueError(f"no such level: {level}")
    if figures:
        packs = packs.filter(figure_selected(figures, F.col("figure_id"), F.when(F.col("figure_id").startswith("Extended Data"), "extended data").otherwise("")))
    if packs.isEmpty():
        raise ValueError("no figure is selected")
    items = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x["id"], F.lit(": "), x["text"])), "\n")
    s = F.col("split")
    bodies = [
        F.col("figure_id"),
        F.coalesce("caption", F.lit("")),
        F.array_join(F.transform(s["panels"], lambda p: F.concat(F.lit("- "), p["label"], F.lit(": "), p["text"])), "\n"),
        items("citing"),
        items("methods"),
        skeleton(F.col("figure_id"), F.col("caption"), F.transform(s["panels"], lambda p: p["label"])),
        F.lit("- n\n- test\n- evidence"),
    ]
    rows = packs.select("paper_id", "figure_id", F.posexplode(F.array(*[F.struct(F.lit(k).alias("key"), b.alias("body")) for k, b in zip(SECTIONS, bodies, strict=True)])).alias("k", "x"))
    rows = rows.select(F.struct("paper_id", "figure_id").alias("ord"), "k", "x.key", "x.body", F.lit(level).alias("level"))
    return numbered(rows, LEVELS, bodies=True).select("ord.paper_id", "ord.figure_id", record_slug(F.col("ord.figure_id")).alias("slug"), "doc")


def pages_label(pages: Column) -> Column:
    first, last = F.array_min(pages), F.array_max(pages)
    run = F.size(pages) == last - first + 1
    return F.when(F.size(pages) == 0, "").otherwise(F.concat(F.lit("p."), F.when(first == last, first.cast("string")).when(run, F.concat(first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(F.array_join(pages.cast("array<string>"), ", "))))


def trust_label(confidence: Column, flagged: Column) -> Column:
    """The trust a record claims, with a mark if it claims high trust against the audit."""
    shown = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), confidence), confidence)
    return F.when((confidence == "high") & flagged, F.concat(shown, F.lit(" ⚠"))).otherwise(shown)


def longest_first(rows: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Of rows with one key the one with the longest text, the first on ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.length(text)), order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
