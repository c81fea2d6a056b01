"""The record schema: one figure with its panels and groups. Fixed values of the data format."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = "1.0"
NOT_REPORTED = "not_reported"
#: How a missing value is shown.
MISSING = "未说明"
#: Besides the sentinel and blanks, texts that count as missing (lower case).
BLANK_TEXTS = ["n/a", "na", "未说明", "-", "—", "none", "null"]

PAPER = "struct<title:string,year:int,venue:string,doi:string>"
DESIGN = "struct<independent_var:string,levels:array<string>,controlled:array<string>,unit:string>"
GROUP = "struct<name:string,role:string,condition:string,n:string,readout:string,result:string,vs_control:string>"
STATS = "struct<test:string,error_bar:string,replicates:string,significance:string>"
EVIDENCE = "struct<from_caption:array<string>,from_body:array<string>,from_methods:array<string>,from_image_only:array<string>,inferred:array<string>>"
PANEL = f"struct<label:string,experiment:string,design:{DESIGN},groups:array<{GROUP}>,stats:{STATS},finding:string,evidence:{EVIDENCE}>"
RECORD = (
    f"schema_version string, paper {PAPER}, domain string, figure_id string, kind string, pages array<int>, images array<string>, caption string, "
    f"figure_kind string, question string, panels array<{PANEL}>, figure_conclusion string, confidence string, open_questions array<string>"
)
#: A record's place: the paper it belongs to and its order within it.
KEYED_RECORD = f"paper_id string, ord long, {RECORD}"

#: Allowed texts of the closed fields.
ENUMS = {
    "domain": ["bio", "mlcs"],
    "kind": ["figure", "table"],
    "figure_kind": ["experiment", "analysis", "qualitative_example", "schematic"],
    "confidence": ["high", "medium", "low"],
    "role": ["treatment", "control", "baseline", "ablation", "reference"],
}
#: What a missing closed field becomes; a low confidence for records that had to be repaired.
ENUM_FALLBACKS = {"domain": "mlcs", "kind": "figure", "figure_kind": "experiment", "confidence": "low", "role": "reference"}
#: Texts whose default is not the sentinel.
TEXT_FALLBACKS = {"schema_version": SCHEMA_VERSION, "caption": "", "title": "", "venue": "", "doi": "", "label": "-"}

#: The long table's columns, with their ASCII names here.
LONG_COLUMNS = {
    "论文标题": "title", "年份": "year", "venue": "venue", "DOI": "doi", "domain": "domain", "figure_id": "figure_id", "图类型": "figure_kind", "页码": "pages",
    "panel": "panel", "实验描述": "experiment", "自变量": "independent_var", "水平": "levels", "受控条件": "controlled", "实验单位": "unit",
    "组名": "name", "组角色": "role", "处理条件": "condition", "n": "n", "测量指标": "readout", "结果": "result", "vs对照": "vs_control",
    "统计检验": "test", "误差棒": "error_bar", "重复": "replicates", "显著性标注": "significance", "panel结论": "finding", "整图结论": "figure_conclusion",
    "置信度": "confidence", "是否需复核": "needs_review", "推断字段": "inferred", "证据来源": "evidence", "图片": "images",
}
#: Evidence buckets in display order, with their labels.
EVIDENCE_LABELS = {"from_caption": "图题", "from_body": "正文", "from_methods": "Methods", "from_image_only": "读图"}


def record_type() -> T.StructType:
    return T.StructType.fromDDL(RECORD)


def json_schema(kind: T.DataType | None = None) -> dict:
    """JSON Schema (draft 2020-12) of the record, derived from its Spark type and the closed fields."""

    def of(t: T.DataType, name: str) -> dict:
        if isinstance(t, T.StructType):
            need = [f.name for f in t.fields if f.name in ("label", "name", "role", "figure_id")]
            return {"type": "object", "properties": {f.name: of(f.dataType, f.name) for f in t.fields}} | ({"required": need} if need else {})
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType, "")}
        if isinstance(t, T.IntegerType):
            return {"type": ["integer", "null"]} if name == "year" else {"type": "integer"}
        return {"type": "string"} | ({"enum": ENUMS[name]} if name in ENUMS else {})

    return {"$schema": "https://json-schema.org/draft/2020-12/schema"} | of(kind or record_type(), "")
