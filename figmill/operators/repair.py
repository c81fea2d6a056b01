"""Repair of loosely structured records: everything readable is kept, the rest falls back and is named in a warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from figmill.functions.text import figure_id_of_slug
from figmill.schema import ENUM_FALLBACKS, ENUMS, NOT_REPORTED, SCHEMA_VERSION, TEXT_FALLBACKS, record_type


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _fallback_text(name: str) -> str:
    return ENUM_FALLBACKS.get(name, TEXT_FALLBACKS.get(name, NOT_REPORTED))


def _scalar(v: Column) -> Column:
    """Text of a scalar variant (booleans are not taken), else null."""
    kind = _kind(v)
    return F.when(v.isNotNull() & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY") & ~kind.isin("BOOLEAN", "VOID"), F.try_variant_get(v, "$", "string"))


def _text(v: Column, name: str) -> Column:
    value = F.coalesce(_scalar(v), F.lit(_fallback_text(name)))
    return F.when(value.isin(ENUMS[name]), value).otherwise(F.lit(ENUM_FALLBACKS[name])) if name in ENUMS else value


def _items(v: Column) -> Column:
    """Elements of a list variant; a scalar is a list of one; else none."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(_scalar(v).isNotNull(), F.array(v)), F.array().cast("array<variant>"))


def _typed(v: Column, kind: T.DataType, name: str) -> Column:
    """The variant as the declared type, with fallbacks all the way down; the type bounds the walk."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_typed(_get(v, f"$.{f.name}", "variant"), f.dataType, f.name).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            return F.transform(F.filter(_items(v), lambda x: _kind(x).startswith("OBJECT")), lambda x: _typed(x, kind.elementType, name))
        if isinstance(kind.elementType, T.IntegerType):
            return F.filter(F.transform(_items(v), lambda x: F.try_variant_get(x, "$", "int")), lambda x: x.isNotNull())
        return F.filter(F.transform(_items(v), _scalar), lambda x: x.isNotNull())
    if isinstance(kind, T.IntegerType):
        return F.try_variant_get(v, "$", "int")
    return _text(v, name)


#: Closed top-level fields that a repair is reported for.
_CLOSED = ["domain", "kind", "figure_kind", "confidence"]


def repair(raw: DataFrame) -> DataFrame:
    """``raw(paper_id, ord, json)`` as (paper_id, ord, record, warnings); record is null if there is no figure to keep.

    A text that is no JSON object, or has no figure_id, is fatal. Numbers become texts,
    scalars lists of one where lists are declared, elements that cannot be read go,
    closed fields outside their values and missing texts fall back.
    """
    v = F.col("v")
    parsed = raw.select("paper_id", "ord", F.try_parse_json("json").alias("v"))
    is_object = F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False))
    named = F.coalesce(F.trim(_scalar(_get(v, "$.figure_id", "variant"))), F.lit("")) != ""
    record = _typed(v, record_type(), "")
    notes = [F.when(~is_object, F.lit("[致命] <root>: 不是 JSON 对象")).when(~named, F.lit("[致命] figure_id: 缺失或为空"))]
    for name in _CLOSED:
        value = _scalar(_get(v, f"$.{name}", "variant"))
        notes.append(F.when(is_object & named & _get(v, f"$.{name}", "variant").isNotNull() & ~F.coalesce(value.isin(ENUMS[name]), F.lit(False)), F.lit(f"[修复] {name}: 取值不合法 → 已回退 {ENUM_FALLBACKS[name]}")))
    version = _scalar(_get(v, "$.schema_version", "variant"))
    notes.append(F.when(is_object & named & version.isNotNull() & (version != SCHEMA_VERSION), F.lit("[复核] schema_version 不一致")))
    notes.append(F.when(is_object & named & _get(v, "$.domain", "variant").isNull(), F.lit("[复核] domain 缺失")))
    dropped = F.size(_items(_get(v, "$.panels", "variant"))) - F.size(F.filter(_items(_get(v, "$.panels", "variant")), lambda x: _kind(x).startswith("OBJECT")))
    notes.append(F.when(is_object & named & (dropped > 0), F.concat(F.lit("[修复] panels: 已丢弃元素 "), dropped.cast("string"))))
    return parsed.select("paper_id", "ord", F.when(is_object & named, record).alias("record"), F.array_compact(F.array(*notes)).alias("warnings"))


def unwrap(raw: DataFrame) -> DataFrame:
    """Files that hold a whole bundle instead of a record, as their figures."""
    inner = F.try_variant_get(F.try_parse_json("json"), "$.figures", "array<variant>")
    each = F.when(inner.isNotNull(), F.transform(inner, lambda x: F.to_json(x))).otherwise(F.array("json"))
    return raw.select("paper_id", "ord", F.posexplode(each).alias("part", "one")).select("paper_id", "ord", "part", F.col("one").alias("json"))


def merge(records: DataFrame) -> DataFrame:
    """Of records(paper_id, ord, figure_id, ...) with one id the last stays, at the place of the first."""
    span = Window.partitionBy("paper_id", "figure_id")
    return records.withColumn("first_ord", F.min("ord").over(span)).withColumn("last_ord", F.max("ord").over(span)).filter("ord = last_ord").drop("last_ord")


def merge_files(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of raw(paper_id, ord, file, json), and warnings (paper_id, ord, warning) in the order of files.

    A file that holds a whole bundle is taken apart, a blank figure_id is guessed from
    the file's name, unreadable files and unusable records are fatal, and of records
    with one id the last stays at the place of the first.
    """
    parsed = F.try_parse_json("json")
    figures = F.try_variant_get(parsed, F.lit("$.figures"), "array<variant>")
    files = raw.select("paper_id", "ord", "file", "json", parsed.isNotNull().alias("readable"), figures.isNotNull().alias("bundle"))
    note = lambda df, text: df.select("paper_id", "ord", F.lit(0).alias("part"), text.alias("warning"))
    broken = note(files.filter("NOT readable"), F.concat(F.lit("[致命] "), "file", F.lit(": 读取失败")))
    taken = note(files.filter("bundle"), F.concat(F.lit("[修复] "), "file", F.lit(": 写成了 bundle 而非单条记录 → 已拆开取用")))
    each = unwrap(files.filter("readable").select("paper_id", "ord", "json")).join(files.select("paper_id", "ord", "file"), ["paper_id", "ord"])
    # a blank id is filled in where it stands, or put first
    own = F.try_variant_get(F.try_parse_json("json"), F.lit("$.figure_id"), "string")
    guess = figure_id_of_slug(F.regexp_replace("file", r"\.[^.]*$", ""))
    blank = F.col("json").startswith("{") & (F.coalesce(F.trim(own), F.lit("")) == "")
    stands = F.col("json").rlike(r'"figure_id"\s*:')
    quoted = F.concat(F.lit('"figure_id":'), F.to_json(F.array(guess)).substr(F.lit(2), F.length(F.to_json(F.array(guess))) - 2))
    empty = F.col("json").rlike(r"^\{\s*\}$")
    filled = F.when(stands, F.regexp_replace("json", F.lit(r'"figure_id"\s*:\s*("\s*"|null)'), quoted)).otherwise(F.concat(F.lit("{"), quoted, F.when(empty, "").otherwise(","), F.expr("substring(json, 2)")))
    each = each.withColumn("guessed", F.when(blank, guess)).withColumn("json", F.when(blank, filled).otherwise(F.col("json")))
    guessed = each.filter("guessed IS NOT NULL").select("paper_id", "ord", "part", F.concat(F.lit("[修复] "), "file", F.lit(": figure_id 缺失 → 按文件名补为 '"), "guessed", F.lit("'")).alias("warning"))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("ord", "part")).cast("long")
    numbered = each.withColumn("place", place)
    fixed = repair(numbered.select("paper_id", F.col("place").alias("ord"), "json"))
    at = numbered.select("paper_id", F.col("place"), F.col("ord").alias("file_ord"), "part", "file")
    found = fixed.withColumnRenamed("ord", "place").join(at, ["paper_id", "place"])
    said = found.select("paper_id", F.col("file_ord").alias("ord"), "part", "file", F.explode("warnings").alias("warning")).withColumn("warning", tag_source(F.col("warning"), F.col("file"))).drop("file")
    lost = found.filter("record IS NULL").select("paper_id", F.col("file_ord").alias("ord"), "part", F.concat(F.lit("[致命] "), "file", F.lit(": 记录不可用，已跳过")).alias("warning"))
    good = found.filter("record IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("paper_id", "record.figure_id").orderBy("place"))
    again = good.withColumn("nth", nth).filter("nth > 1").select("paper_id", F.col("file_ord").alias("ord"), "part", F.concat(F.lit("[复核] "), "record.figure_id", F.lit(" 出现多次，保留最后一份（"), "file", F.lit("）")).alias("warning"))
    records = merge(good.select("paper_id", F.col("place").alias("ord"), "record.*"))
    warnings = broken.unionByName(taken).unionByName(guessed).unionByName(said).unionByName(lost).unionByName(again)
    return records, warnings.select("paper_id", "ord", "warning")


def in_order(records: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merged records with their place among expected(paper_id, figure_id, k), others after them; and one fatal warning for each paper that lacks some."""
    placed = records.join(expected.select("paper_id", "figure_id", "k"), ["paper_id", "figure_id"], "left")
    nth = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.col("k").asc_nulls_last(), "first_ord"))
    lacking = missing(expected, records).groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "figure_id"))), lambda x: x["figure_id"]).alias("ids"))
    text = F.concat(F.lit("[致命] 有 "), F.size("ids").cast("string"), F.lit(" 张图还没抽："), F.array_join("ids", ", "), F.lit("——补齐 extracted/ 后重跑 merge"))
    return placed.withColumn("ord", nth.cast("long")).drop("k"), lacking.select("paper_id", text.alias("warning"))


def missing(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Expected (paper_id, figure_id) without a record."""
    return expected.join(records.select("paper_id", "figure_id"), ["paper_id", "figure_id"], "left_anti")


def tag_source(warning: Column, file: Column) -> Column:
    """The file's name after a warning's tag."""
    head, rest = F.regexp_extract(warning, r"(?s)^(\[[^\]]+\]\s*)(.*)$", 1), F.regexp_extract(warning, r"(?s)^(\[[^\]]+\]\s*)(.*)$", 2)
    return F.when(head != "", F.concat(head, file, F.lit(" · "), rest)).otherwise(F.concat(file, F.lit(" · "), warning))
