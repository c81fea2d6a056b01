"""From nested records to one row a panel, a group, and the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions.exprs import evidence_summary, joined, shown
from figmill.schema import LONG_COLUMNS


def panels(records: DataFrame) -> DataFrame:
    """One row a panel, in order; records without panels give none."""
    return records.select("*", F.posexplode("panels").alias("panel_idx", "p")).drop("panels")


def groups(panel_rows: DataFrame) -> DataFrame:
    """One row a group; panels without groups vanish."""
    return panel_rows.select("*", F.posexplode("p.groups").alias("group_idx", "g"))


def paper_of(own: Column, bundle: Column) -> Column:
    """A figure's own paper if it has a title, else its bundle's."""
    return F.when(F.trim(own["title"]) != "", own).otherwise(bundle)


def long_table(records: DataFrame, bundle_paper: Column | None = None) -> DataFrame:
    """One row a group with all that applies to it, columns in reading order."""
    rows = groups(panels(records))
    meta = paper_of(F.col("paper"), bundle_paper) if bundle_paper is not None else F.col("paper")
    p, g = F.col("p"), F.col("g")
    values = {
        "title": shown(meta["title"], ""), "year": F.coalesce(meta["year"].cast("string"), F.lit("")), "venue": shown(meta["venue"], ""), "doi": shown(meta["doi"], ""),
        "domain": F.col("domain"), "figure_id": F.col("figure_id"), "figure_kind": F.col("figure_kind"), "pages": F.array_join(F.col("pages").cast("array<string>"), ", "),
        "panel": F.coalesce(F.nullif(p["label"], F.lit("")), F.lit("-")), "experiment": shown(p["experiment"]), "independent_var": shown(p["design"]["independent_var"]),
        "levels": joined(p["design"]["levels"], " / "), "controlled": joined(p["design"]["controlled"]), "unit": shown(p["design"]["unit"]),
        "name": shown(g["name"], "-"), "role": g["role"], "condition": shown(g["condition"]), "n": shown(g["n"]), "readout": shown(g["readout"]), "result": shown(g["result"]), "vs_control": shown(g["vs_control"]),
        "test": shown(p["stats"]["test"]), "error_bar": shown(p["stats"]["error_bar"]), "replicates": shown(p["stats"]["replicates"]), "significance": shown(p["stats"]["significance"]),
        "finding": shown(p["finding"]), "figure_conclusion": shown(F.col("figure_conclusion")), "confidence": F.col("confidence"),
        "needs_review": F.when(needs_review(p), "是").otherwise("否"), "inferred": joined(p["evidence"]["inferred"], ", ", ""), "evidence": evidence_summary(p["evidence"]),
        "images": F.array_join(F.transform("images", lambda x: F.translate(x, "\\", "/")), "; "),
    }
    keys = [c for c in ("paper_id", "ord", "panel_idx", "group_idx", "source") if c in rows.columns]
    return rows.select(*keys, *[F.coalesce(values[c], F.lit("")).alias(c) for c in LONG_COLUMNS.values()])


def needs_review(panel: Column) -> Column:
    """The panel itself admits inferred fields."""
    return F.coalesce(F.size(panel["evidence"]["inferred"]) > 0, F.lit(False))


def paper_list(records: DataFrame) -> DataFrame:
    """Figures, panels, groups and panels to review of each paper, counted before rows multiply."""
    counted = records.select(
        "paper_id",
        F.size("panels").alias("p"),
        F.aggregate("panels", F.lit(0), lambda a, x: a + F.size(x["groups"])).alias("g"),
        F.size(F.filter("panels", needs_review)).alias("r"),
    )
    return counted.groupBy("paper_id").agg(F.count("*").alias("figures"), F.sum("p").alias("panels"), F.sum("g").alias("groups"), F.sum("r").alias("review_panels"))


def source_labels(bundles: DataFrame) -> DataFrame:
    """Label of each bundle (paper_id, ord, output_dir, source_pdf, title): the last part of the first path that is set, or the title; repeats get #n."""
    last = lambda c: F.regexp_extract(F.regexp_replace(F.translate(c, "\\", "/"), "/+$", ""), r"([^/]+)$", 1)
    stem = F.regexp_replace(last(F.col("source_pdf")), r"\.[^.]*$", "")
    label = F.coalesce(F.nullif(last(F.col("output_dir")), F.lit("")), F.nullif(stem, F.lit("")), F.nullif(F.trim("title"), F.lit("")), F.lit("?"))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("ord"))
    return bundles.withColumn("base", label).withColumn("source", F.when(nth > 1, F.concat("base", F.lit("#"), nth.cast("string"))).otherwise(F.col("base"))).drop("base")


def corpus_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Long tables of several sources as one, the source first."""
    if not tables:
        raise ValueError("no bundle to unite")
    out = None
    for source, df in tables.items():
        part = df.select(F.lit(source).alias("source"), *[c for c in df.columns if c != "source"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def find(table: DataFrame, text: str | None = None, role: str | None = None, figure: str | None = None) -> DataFrame:
    """Rows of the long table whose searchable columns hold ``text`` (any case), by role and figure."""
    out = table
    if text:
        hay = F.lower(F.concat_ws("\n", "name", "condition", "readout", "result", "vs_control", "n"))
        out = out.filter(hay.contains(text.lower()))
    if role:
        out = out.filter(F.col("role") == role)
    return out.filter(F.col("figure_id") == figure) if figure else out


def summary_rows(records: DataFrame, blank_repeats: bool = True) -> DataFrame:
    """Four-cell summary, one row a group; what repeats within a panel is blank if asked."""
    rows = groups(panels(records))
    first = (F.col("group_idx") == 0) | F.lit(not blank_repeats)
    cell = lambda c: F.when(first, c).otherwise("")
    return rows.select("paper_id", "ord", "figure_id", "panel_idx", "group_idx", cell(F.col("p.label")).alias("panel"), cell(shown(F.col("p.experiment"))).alias("method"), group_cell(F.col("g")).alias("grp"), result_cell(F.col("g")).alias("result"))


def group_cell(g: Column) -> Column:
    """The name, with the condition where that adds words the name has not."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)))
    name, cond = shown(g["name"], "-"), strip_null(g["condition"])
    known = F.size(F.array_intersect(words(name), words(cond))) >= 0.6 * F.size(words(name))
    adds = (cond != "") & ~F.lower(name).contains(F.lower(cond)) & ~F.lower(cond).contains(F.lower(name)) & ~(known & (F.size(words(name)) > 0))
    return F.when(adds, F.concat(name, F.lit("（"), cond, F.lit("）"))).otherwise(name)


def strip_null(c: Column) -> Column:
    return shown(c, "")


def result_cell(g: Column) -> Column:
    """The result, with the comparison where that states significance."""
    value, versus = shown(g["result"]), shown(g["vs_control"], "")
    return F.when(versus.rlike(r"\*|p\s*[<≤]"), F.concat(value, F.lit("，"), versus)).otherwise(value)
