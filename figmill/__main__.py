"""Command line: prep and tasks from layout primitives, merge, audit, render and corpus from record files, schema."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

#: What render can write, in the order in which it does.
OUTPUTS = ["page", "notes", "tables", "mindmap", "table"]
DEPTHS = ["figure", "panel", "group"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="figmill", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    prep = verbs.add_parser("prep", help="lines, captions and page routes from a folder of primitive tables; ends with 2 without them, 3 without text")
    prep.add_argument("--primitives", required=True, help="folder with pages, blocks and words as Parquet")
    tasks = verbs.add_parser("tasks", help="one Markdown task a figure, from tables assets, paragraphs and sections")
    tasks.add_argument("--tables", required=True)
    tasks.add_argument("--level", default="full")
    tasks.add_argument("--figures", default="")
    for verb, text in (("audit", "findings of all records as CSV"), ("merge", "merged records as Parquet; ends with 1 if a file is fatal"), ("render", "notes, tables, mind maps and page data of each paper"), ("corpus", "one long table of all papers")):
        verbs.add_parser(verb, help=text).add_argument("--records", required=True, help="folder with paper/extracted/*.json")
    render = verbs.choices["render"]
    render.add_argument("--outputs", default="all", help="all, or some of " + ",".join(OUTPUTS))
    render.add_argument("--mindmap-depth", default="group", choices=DEPTHS)
    verbs.add_parser("schema", help="JSON Schema of a record")
    for v in verbs.choices.values():
        v.add_argument("--out", required=True)
    return p


def wanted_outputs(spec: str) -> list[str]:
    """The outputs that a spec names, in their usual order; ValueError for others."""
    named = {x.strip() for x in spec.split(",") if x.strip()}
    if unknown := named - {*OUTPUTS, "all"}:
        raise ValueError("no such output: " + ", ".join(sorted(unknown)))
    return [x for x in OUTPUTS if x in named or "all" in named]


def _prep(spark, a) -> int:
    from pyspark.sql import functions as F

    from figmill.functions.text import caption_anchor
    from figmill.operators import layout
    from figmill.sources import records as sources

    try:
        pages, blocks, words = (sources.read_primitives(spark, f"{a.primitives}/{n}.parquet", n) for n in ("pages", "blocks", "words"))
        texts = pages.agg(F.sum("n_chars")).first()[0]
    except Exception as e:  # a table is missing or unreadable
        print(e, file=sys.stderr)
        return 2
    if (texts or 0) < 200:
        return 3
    anchors = blocks.withColumn("a", caption_anchor(F.col("text"))).filter("a IS NOT NULL").select("paper_id", "pno", "block_no", "x0", "y0", "x1", "y1", "a.*")
    for name, table in (("line_rects", layout.line_rects(words)), ("anchors", anchors)):
        table.write.mode("overwrite").parquet(f"{a.out}/{name}")
    return 0


def _tasks(spark, a) -> int:
    from figmill.operators import context, recall, tasks

    read = lambda n: spark.read.parquet(f"{a.tables}/{n}")
    packs = context.packs(read("assets"), read("paragraphs"), read("sections"), recall.term_table(spark))
    tasks.build(packs, a.level, a.figures).write.mode("overwrite").partitionBy("paper_id").parquet(a.out)
    return 0


def _render(records, warnings, a) -> int:
    from figmill.operators import audit, flatten, render

    reasons = audit.review_reasons(records, warnings)
    makers = {
        "page": lambda: render.page_data(records), "notes": lambda: render.paper_notes(records, reasons, warnings), "tables": lambda: render.figure_tables(records),
        "mindmap": lambda: render.mindmaps(records, DEPTHS.index(a.mindmap_depth) + 1), "table": lambda: flatten.long_table(records),
    }
    for name in wanted_outputs(a.outputs):
        makers[name]().write.mode("overwrite").parquet(f"{a.out}/{name}")
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)

    from figmill.sources import records as sources

    if a.verb == "schema":
        sources.write_schema(a.out)
        return 0
    from pyspark.sql import SparkSession

    from figmill.operators import audit, flatten

    spark = SparkSession.builder.getOrCreate()
    if a.verb in ("prep", "tasks"):
        return (_prep if a.verb == "prep" else _tasks)(spark, a)
    if "://" not in a.records and not Path(a.records).exists():
        return 2
    records, warnings = sources.read_records(spark, a.records)
    if a.verb == "render":
        return _render(records, warnings, a)
    if a.verb == "corpus":
        sources.write_csv_parts(flatten.long_table(records), a.out)
    elif a.verb == "audit":
        sources.write_csv_parts(audit.as_warnings(audit.audit(records)), a.out)
    else:
        records.write.mode("overwrite").parquet(a.out)
        return int(warnings.filter("warning LIKE '[致命]%'").limit(1).count() > 0)
    return 0


if __name__ == "__main__":
    sys.exit(main())
