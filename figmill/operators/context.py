"""Context packs: for each figure its panels, the paragraphs that cite it, its keywords and the methods they recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figmill.functions.kernels import panel_split
from figmill.operators.recall import citing, keywords, methods, term_pattern

_KEY = ["paper_id", "figure_id"]


def _doc():
    return F.concat_ws("\x1f", "paper_id", "figure_id")


def packs(assets: DataFrame, paragraphs: DataFrame, sections: DataFrame, terms: DataFrame) -> DataFrame:
    """One pack an asset, cited or not.

    assets(paper_id, figure_id, kind, number, caption), paragraphs(paper_id, ord, id, section_id, text),
    sections(paper_id, id, title, is_methods), terms as recall.term_table gives them. Returns paper_id, figure_id,
    caption, split (panels, preamble, trailer), citing and methods as ordered arrays, over (ids beyond the limit), keywords.
    """
    split = assets.select(*_KEY, "caption", panel_split(F.col("caption")).alias("split"))
    met = citing(assets, paragraphs).filter("id IS NOT NULL").join(paragraphs.select("paper_id", "id", "text"), ["paper_id", "id"])
    ordered = lambda when, item: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("nth", item.alias("x"))))), lambda s: s["x"])
    cited = met.groupBy(*_KEY).agg(ordered(~F.col("over"), F.struct("id", "text")).alias("citing"), ordered(F.col("over"), F.col("id")).alias("over"))
    # words of captions count for more than those of paragraphs
    said = assets.select(_doc().alias("doc"), F.lit("caption").alias("origin"), F.col("caption").alias("text"))
    said = said.unionByName(met.filter(~F.col("over")).select(_doc().alias("doc"), F.lit("body").alias("origin"), "text"))
    words = keywords(said, terms)
    in_caption = assets.select(_doc().alias("doc"), F.lower("caption").alias("low"))
    origin = F.when(F.contains(F.col("low"), F.col("key")), "caption").otherwise("body")
    rows = words.join(in_caption, "doc").select("doc", term_pattern(F.col("word")).alias("pattern"), "weight", origin.alias("origin"))
    named = sections.filter("is_methods").select("paper_id", F.col("id").alias("section_id"), "title")
    known = met.filter(~F.col("over")).select(*_KEY, "id", F.lit(True).alias("excluded"))
    usable = assets.select(*_KEY).join(paragraphs.join(named, ["paper_id", "section_id"]), "paper_id").join(known, [*_KEY, "id"], "left")
    usable = usable.select(_doc().alias("doc"), "ord", "id", "title", "text", F.coalesce("excluded", F.lit(False)).alias("excluded"))
    recalled = methods(rows, usable).join(usable.select("doc", "id", "text"), ["doc", "id"])
    rank = F.when(F.col("how") == "pinned", 1).otherwise(0)
    recalled = recalled.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), (-F.col("score")).alias("s"), "id", "text", "score", "how"))), lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"), x["score"].alias("score"), x["how"].alias("how"))).alias("methods"))
    top = words.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    out = split.join(cited, _KEY, "left").withColumn("doc", _doc()).join(top, "doc", "left").join(recalled, "doc", "left")
    lists = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("citing", "over", "keywords", "methods")}
    return out.withColumns(lists).drop("doc")
