"""Native column expressions. Nothing here runs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from figmill.schema import BLANK_TEXTS, EVIDENCE_LABELS, MISSING, NOT_REPORTED


def strip(c: Column) -> Column:
    """Without white space (any Unicode kind) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm_ws(c: Column) -> Column:
    """Runs of white space (any Unicode kind) as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_reported(c: Column) -> Column:
    """Whether a text field says something: not null, not blank, no sentinel (with or without a reason), no missing mark."""
    return _says(F.lower(strip(c)))


def reported_parts(parts: Column) -> Column:
    """The items of a list that are reported; each is read once, which counts in lists of many."""
    return F.filter(parts, lambda c: F.exists(F.array(F.lower(strip(c))), _says))


def _says(low: Column) -> Column:
    return F.coalesce((low != "") & ~low.startswith(NOT_REPORTED) & ~low.isin(BLANK_TEXTS), F.lit(False))


def any_reported(c: Column) -> Column:
    """The same for a list field."""
    return F.coalesce(F.size(c) > 0, F.lit(False))


def shown(c: Column, default: str = MISSING) -> Column:
    """The text if reported, else the default."""
    return F.when(is_reported(c), strip(c)).otherwise(F.lit(default))


def joined(c: Column, sep: str = "；", default: str = MISSING) -> Column:
    """The non-blank items, or the default if there are none."""
    items = F.filter(F.transform(c, strip), lambda x: x != "")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, sep)).otherwise(F.lit(default))


def clean_sentinel(c: Column) -> Column:
    """A sentinel as the missing mark, with its reason kept in brackets; other texts as they are."""
    low = F.lower(strip(c))
    reason = F.regexp_extract(strip(c), r"(?is)^not_reported\s*[（(](.+)[）)]\s*$", 1)
    return F.when(low.startswith(NOT_REPORTED) & (reason != ""), F.concat(F.lit(MISSING + "（"), reason, F.lit("）"))).when(is_reported(c), strip(c)).otherwise(F.lit(MISSING))


def all_evidence(e: Column) -> Column:
    return F.concat(*[F.coalesce(e[b], F.array().cast("array<string>")) for b in (*EVIDENCE_LABELS, "inferred")])


def evidence_summary(e: Column) -> Column:
    """Labelled entries of the four buckets that name sources."""
    parts = [F.when(any_reported(e[b]), F.concat(F.lit(f"{label}: "), F.array_join(e[b], ", "))) for b, label in EVIDENCE_LABELS.items()]
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) > 0, F.array_join(found, "；")).otherwise(F.lit(MISSING))


def display_width(c: Column) -> Column:
    """Characters, those beyond U+2E7F counted twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x{0}-\x{2E7F}]", ""))


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` characters, cut with an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.regexp_replace(F.substring(c, 1, most - 1), r"(?U)\s+$", ""), F.lit("…"))).otherwise(c)


def truncated_to_width(c: Column, most: int) -> Column:
    """As many characters as fit a display width, cut with an ellipsis."""
    wide = lambda ch: F.when(ch.rlike(r"[\x{0}-\x{2E7F}]"), 1).otherwise(2)
    zero = F.struct(F.lit(0).alias("w"), F.lit("").alias("s"))

    def take(acc: Column, ch: Column) -> Column:
        w = acc["w"] + wide(ch)
        return F.struct(w.alias("w"), F.when(w <= most - 1, F.concat(acc["s"], ch)).otherwise(acc["s"]).alias("s"))

    fit = F.aggregate(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), zero, take, lambda a: a["s"])
    return F.when(display_width(c) <= most, c).otherwise(F.concat(F.regexp_replace(fit, r"(?U)\s+$", ""), F.lit("…")))


def overlap_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def half_even_percent(part: Column, whole: Column) -> Column:
    """Whole per cent, halves to the even number, of at least one."""
    return F.bround(100.0 * part / F.greatest(F.lit(1), whole), 0).cast("long")


#: Characters that Mermaid texts cannot hold and their full-width forms.
MERMAID_FROM, MERMAID_TO = "()[]{}<>\"`;:#|&%\\", "（）［］｛｝＜＞＂｀；：＃｜＆％＼"


def mermaid_text(c: Column) -> Column:
    return F.translate(norm_ws(c), MERMAID_FROM, MERMAID_TO)


def html_text(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attr(c: Column) -> Column:
    return F.replace(html_text(c), F.lit('"'), F.lit("&quot;"))


def md_cell(c: Column) -> Column:
    """A text for one cell of a Markdown table."""
    return F.replace(F.replace(F.replace(norm_ws(c), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("<"), F.lit("&lt;"))


def natural_key(c: Column) -> Column:
    """Sort key by number and text chunks: digits compare as numbers, letters without case."""
    chunks = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.transform(chunks, lambda x: F.struct(F.when(x.rlike(r"^\d"), 0).otherwise(1).alias("kind"), F.coalesce(F.try_to_number(x, F.lit("999999999999999999")).cast("long"), F.lit(0)).alias("number"), x.alias("text")))


#: Values of Roman digits.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def roman_value(c: Column) -> Column:
    """Value of Roman digits in any order (a smaller one before a larger is taken away); null for other texts."""
    digits = F.reverse(F.split(F.upper(F.trim(c)), ""))
    value = lambda d: F.element_at(F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))]), d)
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("most"))
    total = F.aggregate(F.filter(digits, lambda d: d != ""), zero, lambda a, d: F.struct((a["sum"] + F.when(value(d) < a["most"], -value(d)).otherwise(value(d))).alias("sum"), F.greatest(a["most"], value(d)).alias("most")), lambda a: a["sum"])
    return F.when(F.upper(F.trim(c)).rlike("^[IVXLCDM]+$"), total)


def norm_number(c: Column) -> Column:
    """Figure numbers on one footing: leading zeros and spaces off, Roman numbers as digits."""
    s = F.regexp_replace(F.upper(F.trim(c)), r"[  ]", "")
    lead, digits = F.regexp_extract(s, r"^([SE]D?)?0*(\d+)$", 1), F.regexp_extract(s, r"^([SE]D?)?0*(\d+)$", 2)
    return F.when(digits != "", F.concat(lead, digits)).otherwise(F.coalesce(roman_value(s).cast("string"), s))
