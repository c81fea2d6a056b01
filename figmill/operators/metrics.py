"""Ratios, counts and votes over records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions.exprs import half_even_percent, is_reported
from figmill.operators.flatten import groups, needs_review, panels

PANEL_FIELDS = ["test", "error_bar", "replicates"]


def completeness(records: DataFrame) -> DataFrame:
    """Reported and total of n (by group) and of the statistics fields (by panel)."""
    p = panels(records)
    by_group = groups(p).agg(F.sum(is_reported(F.col("g.n")).cast("long")).alias("reported"), F.count("*").alias("total")).select(F.lit("n").alias("field"), "reported", "total")
    sums = p.agg(F.count("*").alias("total"), *[F.sum(is_reported(F.col(f"p.stats.{f}")).cast("long")).alias(f) for f in PANEL_FIELDS])
    by_panel = sums.select("total", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("reported")) for f in PANEL_FIELDS])).alias("x")).select("x.field", "x.reported", "total")
    return by_group.unionByName(by_panel).select("field", F.coalesce("reported", F.lit(0)).alias("reported"), "total")


def kpi(records: DataFrame) -> DataFrame:
    """Headline numbers: figures, panels, groups, per cent of reported n and tests, panels to review."""
    each = records.select(
        F.size("panels").alias("p"),
        F.aggregate("panels", F.lit(0), lambda a, x: a + F.size(x["groups"])).alias("g"),
        F.aggregate("panels", F.lit(0), lambda a, x: a + F.size(F.filter(x["groups"], lambda y: is_reported(y["n"])))).alias("n"),
        F.size(F.filter("panels", lambda x: is_reported(x["stats"]["test"]))).alias("t"),
        F.size(F.filter("panels", needs_review)).alias("r"),
    )
    total = each.agg(F.count("*").alias("figures"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "pgntr"])
    return total.select("figures", F.col("p").alias("panels"), F.col("g").alias("groups"), half_even_percent(F.col("n"), F.col("g")).alias("n_rate"), half_even_percent(F.col("t"), F.col("p")).alias("test_rate"), F.col("r").alias("review"))


def domain_vote(records: DataFrame) -> DataFrame:
    """Each paper's most frequent domain, ties to the one met first; whether all agree."""
    votes = records.groupBy("paper_id", "domain").agg(F.count("*").alias("votes"), F.min("ord").alias("first"))
    return votes.groupBy("paper_id").agg(F.max_by("domain", F.struct("votes", -F.col("first"))).alias("domain"), F.max("votes").alias("votes"), (F.count("*") > 1).alias("disputed"))


def pick_paper(records: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Each paper's data from its first record with a title, else from ``fallback(paper_id, title)``."""
    titled = F.trim(F.coalesce("paper.title", F.lit(""))) != ""
    best = records.groupBy("paper_id").agg(F.min_by(F.when(titled, F.col("paper")), F.when(titled, F.col("ord"))).alias("paper"))
    if fallback is None:
        return best.select("paper_id", "paper.title", "paper.year", "paper.venue")
    return best.join(fallback.withColumnRenamed("title", "other"), "paper_id", "left").select("paper_id", F.coalesce("paper.title", "other").alias("title"), "paper.year", "paper.venue")


def common_readout(records: DataFrame) -> DataFrame:
    """A panel's readout where all reported ones agree, else blank."""
    seen = F.array_distinct(F.transform(F.filter("p.groups", lambda g: is_reported(g["readout"])), lambda g: F.trim(g["readout"])))
    return panels(records).select("paper_id", "ord", "panel_idx", F.when(F.size(seen) == 1, F.get(seen, F.lit(0))).otherwise("").alias("readout"))


def reported_treatments(records: DataFrame) -> DataFrame:
    """The flagship question: treatment groups that state a sample size, by readout, and the papers they are from."""
    rows = groups(panels(records)).filter((F.col("g.role") == "treatment") & is_reported(F.col("g.n")))
    return rows.groupBy(F.col("g.readout").alias("readout")).agg(F.count("*").alias("n_groups"), F.countDistinct("paper_id").alias("n_papers"))


def figure_overview(records: DataFrame) -> DataFrame:
    """One row a figure: its kind, panels, groups, trust."""
    number = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord"))
    return records.select("paper_id", number.cast("long").alias("number"), "figure_id", "figure_kind", F.size("panels").cast("long").alias("panels"), F.aggregate("panels", F.lit(0).cast("long"), lambda a, x: a + F.size(x["groups"])).alias("groups"), "confidence")
