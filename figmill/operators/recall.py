"""Context of a figure: the paragraphs that cite it and the methods that its words recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions.exprs import norm_number
from figmill.functions.kernels import citations
from figmill.functions.text import is_caption_echo

# Limits, and weights of keyword kinds; a caption's words count twice.
MOST_CITING, MOST_KEYWORDS, TOP_METHODS, FALLBACK_METHODS, PINNED = 12, 40, 5, 2, 2
LEAST_SCORE, LONG_WORDS = 1.0, 250
WEIGHTS = {"cell_line": 1.6, "model": 1.6, "dataset": 1.6, "animal": 1.5, "assay": 1.4, "reagent": 1.4, "code": 1.3, "metric": 1.1, "acronym": 1.0, "hyperparam": 0.8, "generic": 0.6}
METHOD_TITLES = r"(?iu)method|experimental setup|experimental settings|materials|实验方法|材料与方法|实验设置"
STATISTICS_TITLES = r"(?iu)statistic|统计|significance test"
#: A few terms of each kind; callers pass their own table for more.
TERMS = {
    "cell_line": ["HeLa", "A549", "HEK293", "U251", "Jurkat"], "animal": ["C57BL/6", "BALB/c", "nude mice", "小鼠"], "assay": ["CCK-8", "western blot", "qPCR", "flow cytometry", "ELISA"],
    "reagent": ["DMSO", "FBS", "cisplatin", "PBS"], "model": ["BERT", "GPT-4", "T5", "ResNet"], "dataset": ["GLUE", "SQuAD", "ImageNet", "MMLU"], "metric": ["BLEU", "accuracy", "F1", "AUC"],
    "hyperparam": ["learning rate", "batch size", "dropout"], "generic": ["antibody", "kit", "ANOVA", "t-test"],
}


def term_pattern(term: Column) -> Column:
    """Pattern of a keyword: whole words, usual endings for longer ones, exact case for short capitals, plain text for Chinese."""
    quoted = F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))
    last = F.right(term, F.lit(1))
    double = F.when(last.rlike("(?i)[a-z]") & ~last.rlike("(?i)[aeiou]"), F.concat(last, F.lit("?"))).otherwise("")
    ending = F.when((F.length(term) >= 5) | F.contains(term, F.lit(" ")), F.concat(F.lit("(?:"), double, F.lit("(?:e?s|e?d|ing))?"))).otherwise("")
    flags = F.when((F.length(term) <= 4) & (term == F.upper(term)) & term.rlike("[A-Z]"), "").otherwise("(?i)")
    return F.when(term.rlike(r"[一-鿿]"), quoted).otherwise(F.concat(flags, F.lit("(?<![A-Za-z0-9])"), quoted, ending, F.lit("(?![A-Za-z0-9])")))


def term_table(spark, terms: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(t, c, WEIGHTS[c]) for c, ts in (terms or TERMS).items() for t in ts]
    return spark.createDataFrame(rows, "term string, category string, weight double").withColumn("pattern", term_pattern(F.col("term")))


def citing(assets: DataFrame, paragraphs: DataFrame, most: int = MOST_CITING) -> DataFrame:
    """Paragraphs that cite each asset, in document order: paper_id, figure_id, id, nth, over (beyond the limit).

    assets(paper_id, figure_id, kind, number, caption), paragraphs(paper_id, ord, id, text).
    Assets without one keep a row of nulls.
    """
    refs = paragraphs.select("paper_id", "ord", "id", "text", F.explode(citations(F.col("text"))).alias("r"))
    refs = refs.groupBy("paper_id", "ord", "id", "text", F.col("r.kind").alias("kind"), F.col("r.number").alias("match")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r.panels")))).alias("panels"))
    keyed = assets.withColumn("match", norm_number(F.col("number")))
    met = keyed.join(refs, ["paper_id", "kind", "match"], "left").filter(F.col("id").isNull() | ~is_caption_echo(F.col("text"), F.col("caption")))
    lost = keyed.join(met, ["paper_id", "figure_id"], "left_anti")
    met = met.unionByName(lost, allowMissingColumns=True)
    nth = F.when(F.col("id").isNotNull(), F.row_number().over(Window.partitionBy("paper_id", "figure_id").orderBy("ord")))
    return met.withColumn("nth", nth).select("paper_id", "figure_id", "id", "nth", "panels", (F.col("nth") > most).alias("over"))


def keywords(texts: DataFrame, terms: DataFrame, most: int = MOST_KEYWORDS) -> DataFrame:
    """Keywords of texts(doc, origin, text), best first; a key keeps its highest weight; captions count twice."""
    hits = texts.join(F.broadcast(terms), F.expr("text rlike pattern")).select("doc", "origin", F.col("term").alias("word"), "category", "weight")
    found = lambda pattern, kind: texts.select("doc", "origin", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word"), F.lit(kind).alias("category"), F.lit(WEIGHTS[kind]).alias("weight"))
    codes = found(r"\b[A-Za-z]{1,6}[-‑]?\d{1,4}[A-Za-z]?\d{0,3}\b", "code").filter("length(word) >= 3")
    codes = codes.filter(~F.lower(F.regexp_extract("word", "^[A-Za-z]+", 0)).isin("fig", "figs", "figure", "table", "tab", "eq", "ref", "sec", "step", "day", "h", "d", "min", "mg", "kg", "ml", "no"))
    capitals = found(r"\b[A-Z]{2,8}(?:[-‑][A-Z0-9]{1,8})*\b", "acronym").filter(~F.col("word").isin("THE", "AND", "FOR", "NOT", "FIG", "TABLE", "SD", "SEM", "CI", "DNA", "RNA", "II", "III", "IV"))
    every = hits.unionByName(codes).unionByName(capitals).withColumn("weight", F.col("weight") * F.when(F.col("origin") == "caption", 2.0).otherwise(1.0)).withColumn("key", F.replace(F.lower("word"), F.lit("‑"), F.lit("-")))
    best = every.groupBy("doc", "key").agg(F.max_by("word", F.struct("weight", "word")).alias("word"), F.max("weight").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("weight"), "key"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most)


def methods(keyword_rows: DataFrame, paragraphs: DataFrame, top: int = TOP_METHODS) -> DataFrame:
    """Methods paragraphs that each document's keywords recall: doc, id, score, how (hit, fallback, pinned).

    keyword_rows(doc, pattern, weight, origin), paragraphs(doc, ord, id, title, text, excluded).
    Each keyword counts once; long paragraphs count less; titles like methods and titles
    with a caption's keyword count more. Without a hit the first two paragraphs serve;
    up to two on statistics come on top.
    """
    usable = paragraphs.filter(~F.coalesce("excluded", F.lit(False)))
    met = usable.join(keyword_rows, "doc")
    in_title = F.when((F.col("origin") == "caption") & F.expr("title rlike pattern"), 1.0).otherwise(0.0)
    words = F.greatest(F.lit(1), F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")))
    hit = F.expr("text rlike pattern")
    scored = met.groupBy("doc", "ord", "id", "title", "text").agg(F.sum(F.when(hit, F.col("weight")).otherwise(0.0)).alias("raw"), F.sum(in_title).alias("titled"))
    scored = scored.filter("raw > 0").withColumn("score", F.round(F.col("raw") * F.when(words <= LONG_WORDS, 1.0).otherwise(F.sqrt(LONG_WORDS / words)) + F.when(F.col("title").rlike(METHOD_TITLES), 0.5).otherwise(0.0) + F.col("titled"), 2))
    order = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "id"))
    picked = scored.filter(F.col("score") >= LEAST_SCORE).withColumn("rank", order).filter(F.col("rank") <= top).select("doc", "id", "score", F.lit("hit").alias("how"))
    first = paragraphs.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("ord"))).filter((F.col("rank") <= FALLBACK_METHODS) & ~F.coalesce("excluded", F.lit(False)))
    fallback = first.join(picked.select("doc").distinct(), "doc", "left_anti").select("doc", "id", F.lit(0.0).alias("score"), F.lit("fallback").alias("how"))
    chosen = picked.unionByName(fallback)
    stats = usable.filter(F.col("title").rlike(STATISTICS_TITLES)).join(chosen.select("doc", "id"), ["doc", "id"], "left_anti")
    pinned = stats.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("ord"))).filter(F.col("rank") <= PINNED).select("doc", "id", F.lit(0.0).alias("score"), F.lit("pinned").alias("how"))
    return chosen.unionByName(pinned)


def breadcrumbs(sections: DataFrame) -> DataFrame:
    """Trail of each of sections(paper_id, id, title): all sections whose dotted id begins its own, in order; gaps are left out."""
    parts = F.split(F.regexp_replace("id", "^§", ""), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.lit("§"), F.array_join(F.slice(parts, 1, n), ".")))
    up = sections.select("paper_id", "id", F.posexplode(prefixes).alias("level", "above"))
    named = up.join(sections.select("paper_id", F.col("id").alias("above"), "title"), ["paper_id", "above"])
    trail = F.array_sort(F.collect_list(F.struct("level", F.concat("above", F.lit(" "), "title").alias("text"))))
    return named.groupBy("paper_id", "id").agg(F.array_join(F.transform(trail, lambda x: x["text"]), " › ").alias("trail"))
