"""Scans and sinks of records: JSON in, Parquet tables, CSV with a byte-order mark, a small xlsx, pages and outlines out."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.operators.repair import merge_files
from figmill.schema import KEYED_RECORD, json_schema

PRIMITIVES = {
    "pages": "paper_id string, pno int, width double, height double, n_chars int",
    "blocks": "paper_id string, pno int, block_no int, x0 double, y0 double, x1 double, y1 double, text string",
    "words": "paper_id string, pno int, block_no int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, text string",
    "spans": "paper_id string, pno int, block_no int, line_no int, span_no int, x0 double, y0 double, x1 double, y1 double, text string, font string, size double, flags int",
    "images": "paper_id string, pno int, img_no int, x0 double, y0 double, x1 double, y1 double",
    "drawings": "paper_id string, pno int, drw_no int, x0 double, y0 double, x1 double, y1 double",
}


def read_primitives(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of layout primitives, as Parquet or JSON lines, under its declared schema."""
    reader = spark.read.schema(PRIMITIVES[name])
    return reader.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else reader.parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw record files paper/extracted/name.json as (paper_id, ord, json, file), in name order within a paper."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return raw.select(F.element_at(parts, -3).alias("paper_id"), F.element_at(parts, -1).alias("file"), F.col("value").alias("json")).selectExpr("paper_id", "row_number() over (partition by paper_id order by file) as ord", "json", "file")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Repaired and merged records of all files, and their warnings."""
    records, warnings = merge_files(read_files(spark, path).withColumn("ord", F.col("ord").cast("long")))
    return records.select("paper_id", "ord", *[c for c in records.columns if c not in ("paper_id", "ord", "first_ord")]), warnings


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Figures of bundle files under the declared schema."""
    from pyspark.sql import types as T

    fields = [f for f in T.StructType.fromDDL(KEYED_RECORD).fields if f.name not in ("paper_id", "ord")]
    bundle = T.StructType([T.StructField("source_pdf", T.StringType()), T.StructField("output_dir", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())), T.StructField("figures", T.ArrayType(T.StructType(fields)))])
    b = spark.read.schema(bundle).option("multiLine", "true").json(path)
    return b.select(F.col("_metadata.file_path").alias("paper_id"), "source_pdf", "output_dir", "warnings", F.posexplode("figures").alias("ord", "f")).select("paper_id", "ord", "source_pdf", "output_dir", "warnings", "f.*")


def write_csv_parts(table: DataFrame, path: str) -> None:
    """CSV files in a folder, written where the rows are; each begins with a byte-order mark and the header."""
    marked = table.select(*[F.col(f"`{c}`").cast("string").alias(("\ufeff" if k == 0 else "") + c) for k, c in enumerate(table.columns)])
    marked.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path)


def write_csv(table: DataFrame, path: str) -> int:
    """One CSV file with a byte-order mark, streamed through the driver row by row; rows written."""
    import csv

    n = 0
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(table.columns)
        for row in table.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def width(text: str) -> int:
    """Characters, wide ones counted twice."""
    return sum(2 if ord(c) > 0x2E7F else 1 for c in text)


def write_xlsx(sheets: dict[str, tuple[list[str], list[tuple]]], path: str) -> None:
    """A workbook of text sheets: frozen header, filter, widths by content (8 to 42), no text taken for a formula."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    letter = lambda i: (letter(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    cell = lambda r, c, v: f'<c r="{letter(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(len(names)))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{over}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(names))) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        for i, (columns, rows) in enumerate(sheets.values()):
            widths = [min(42, max(8, 2 + max([width(str(c)), *(width(str(r[k] or "")) for r in rows)]))) for k, c in enumerate(columns)]
            cols = "".join(f'<col min="{k + 1}" max="{k + 1}" width="{w}" customWidth="1"/>' for k, w in enumerate(widths))
            body = "".join(f'<row r="{n}">' + "".join(cell(n, k, v) for k, v in enumerate(r)) + "</row>" for n, r in enumerate([columns, *rows], 1))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols>{cols}</cols><sheetData>{body}</sheetData><autoFilter ref="A1:{letter(len(columns) - 1)}{len(rows) + 1}"/></worksheet>')


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def write_schema(path: str) -> None:
    write_json(json_schema(), path)


def page_html(template: str, data: object) -> str:
    """A page with its data in place of __DATA__, closing tags inside the data made harmless."""
    return template.replace("__DATA__", json.dumps(data, ensure_ascii=False, separators=(",", ":")).replace("</", "<\\/"))


def decode_pdfs(spark: SparkSession, path: str, decoder) -> DataFrame:
    """Word primitives of PDF files by a caller's decoder(bytes) -> rows, one file a row; this library ships none."""
    import pandas as pd

    names = [c.split()[0] for c in PRIMITIVES["words"].split(", ")]

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in decoder(bytes(content))], columns=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content").mapInPandas(run, PRIMITIVES["words"])
