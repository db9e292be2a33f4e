"""Column functions on text: cleaning, normal forms, small parsers.  All run in the JVM except NFKC."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Role prefixes and quotes that generated expressions carry, in the order they are tried.
PATIENT_PREFIXES = ["患者:", "患者「", "患者｢", "「", "『"]
DOCTOR_PREFIXES = ["医師所見:", "医師記載:", "所見:", "症状:", "記載:", "カルテ:", "医師:", "「", "『", '"', "“", "”"]
CLOSING = ["」", "『", "』", "｡"]
# List marks and quotes around labels.
BULLETS = ["- ", "・", "●", "1.", "1)", "①", "▶"]
EDGE_QUOTES = ['"', "「", "」", "『", "』", "'"]
# Interface text that a dictionary site leaves in labels.
SITE_NOISE = ["意味・読み方・使い方", "ピン留め追加できません", "発音を聞くプレーヤー再生", "単語を追加"]
# Endings and words of clinical rather than everyday language.
CLINICAL_ENDING = "(症|炎|障害|癌|腫瘍|腫瘤|病)$"
CLINICAL_WORDS = ["ヘルニア", "症候群", "再発", "手術", "術", "切除", "腫瘍", "腫瘤", "癌", "がん", "悪性", "良性", "既往", "合併症", "検査", "治療"]
POLITE_ENDINGS = ["です", "ます"]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def literal(text: str) -> str:
    """A regular expression that matches exactly this text."""
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides; null stays null."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def lstrip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+", "")


def rstrip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\s+$", "")


def safe_str(col: Column) -> Column:
    """Null becomes the empty text."""
    return F.coalesce(col.cast("string"), F.lit(""))


def safe_int(col: Column, default: int = 0) -> Column:
    return F.coalesce(col.try_cast("int"), F.lit(default))


def blank_to_null(col: Column) -> Column:
    return F.when(col.rlike(r"(?U)\S"), col)


def first_present(*cols: Column) -> Column:
    """The first value that is neither null nor empty (an empty text falls through), else null."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in cols])


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(col: Column) -> Column:
    """NFKC; Spark has no built-in, so this is one Arrow call."""
    return _nfkc(col)


def match_key(col: Column) -> Column:
    """The form texts are compared by: NFKC, lower case, no spaces of either kind; null gives ''."""
    return F.translate(strip(F.lower(nfkc(safe_str(col)))), " 　", "")


def compare_key(col: Column) -> Column:
    """White space trimmed and runs of it (wide space included) reduced to one plain space."""
    return F.regexp_replace(strip(safe_str(col)), r"(?U)\s+", " ")


def no_spaces(col: Column) -> Column:
    return F.translate(col, " 　", "")


def first_line(col: Column) -> Column:
    """The first line, trimmed; a text of white space only gives ''."""
    return strip(F.regexp_extract(strip(col), r"^([^\n\r\x0B\f\x1C-\x1E\x85  ]*)", 1))


def _drop_prefixes(col: Column, prefixes: list[str]) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, rf"(?U)^{literal(p)}\s*", ""), prefixes, col)


def _drop_suffixes(col: Column, suffixes: list[str]) -> Column:
    return reduce(lambda c, x: F.regexp_replace(c, rf"(?U)\s*{literal(x)}$", ""), suffixes, col)


def clean_expression(col: Column, mode: str | Column = "patient", cut_inside: bool = True) -> Column:
    """A generated expression without chat residue, role labels and quotes; null gives ''.

    First line only; everything from the first "assistant" on is dropped (with ``cut_inside`` off
    only a trailing one); then each prefix and closing sign, in order, at most once.  ``mode`` is
    "patient" or anything else for the doctor's prefixes, as a text or a column.
    """
    line = first_line(safe_str(col))
    cut = r"(?is)assistant[:：]?.*$" if cut_inside else r"(?i)\s*assistant[:：]?\s*$"
    line = strip(F.regexp_replace(line, cut, ""))

    def branch(prefixes: list[str]) -> Column:
        return _drop_suffixes(_drop_prefixes(line, prefixes), CLOSING)

    if isinstance(mode, str):
        return branch(PATIENT_PREFIXES if mode == "patient" else DOCTOR_PREFIXES)
    return F.when(mode == "patient", branch(PATIENT_PREFIXES)).otherwise(branch(DOCTOR_PREFIXES))


def clean_label(col: Column) -> Column:
    """The label in a model's answer: first line, no bullet, no matching edge quotes, no final stop."""
    out = first_line(safe_str(col))
    for b in BULLETS:
        out = F.regexp_replace(out, rf"(?U)^{literal(b)}\s*", "")
    for q in EDGE_QUOTES:
        out = F.regexp_replace(out, rf"(?Us)^{literal(q)}\s*(.+?)\s*{literal(q)}$", "$1")
    return F.regexp_replace(out, r"(?U)\s*。$", "")


def shorten(col: Column, limit: int = 400, mark: str = " …", default: str = "") -> Column:
    """At most ``limit`` characters, then ``mark``; null and blank give ``default``."""
    text = F.when(F.length(col) > limit, F.concat(F.left(col, F.lit(limit)), F.lit(mark))).otherwise(col)
    return F.coalesce(blank_to_null(text), F.lit(default))


def first_sentence(col: Column, limit: int = 100, stop: str = "。") -> Column:
    """Up to and with the first stop, at most ``limit`` characters."""
    return F.left(F.regexp_extract(col, rf"(?s)^([^{stop}]*{stop}?)", 1), F.lit(limit))


def detect_mode(col: Column, default: str | Column) -> Column:
    low = F.lower(safe_str(col))
    other = F.lit(default) if isinstance(default, str) else default
    return F.when(low.contains("doctor"), F.lit("doctor")).when(low.contains("patient"), F.lit("patient")).otherwise(other)


def frequency_rank(col: Column, never: str = "出現なし") -> Column:
    """"a-b%" gives b div 5; ``never`` and anything else give 0."""
    high = F.regexp_extract(strip(safe_str(col)), r"^\d+-(\d+)%", 1)
    return F.coalesce((high.try_cast("int") / 5).cast("int"), F.lit(0))


def int_key(col: Column, unknown: str = "unknown") -> Column:
    """The whole number a text stands for ("3", "3.0"), as text; ``unknown`` for anything else."""
    return F.coalesce(col.try_cast("double").try_cast("bigint").cast("string"), F.lit(unknown))


def depth_of(col: Column, missing: int = 999, strict: bool = False) -> Column:
    """Depth of an ontology row; "3.0" counts as 3 unless ``strict``; anything else gives ``missing``."""
    value = strip(col).try_cast("int") if strict else strip(col).try_cast("double").try_cast("int")
    return F.coalesce(value, F.lit(missing))


def log_length(col: Column) -> Column:
    return F.log1p(F.coalesce(F.length(col), F.lit(0)).cast("double"))


def tag(*cols: Column, sep: str = "_") -> Column:
    """A file-name-safe tag from several values."""
    return F.concat_ws(sep, *[F.translate(c.cast("string"), "/-", "__") for c in cols])


def has_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words], F.lit(False))


def clear_noise(col: Column, words: list[str] | None = None) -> Column:
    """Null where the text holds one of the interface texts."""
    return F.when(~F.coalesce(has_any(col, words or SITE_NOISE), F.lit(False)), col)


def at_least(col: Column, least: float, *also: Column) -> Column:
    """A number, written as text or not, of at least ``least``, and every further condition; false where it is no number."""
    return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), also, F.coalesce(strip(col.cast("string")).try_cast("double") >= least, F.lit(False)))


def listed(col: Column, wanted: list[str]) -> Column:
    """Is the trimmed value one of the list?  An empty list accepts everything."""
    return F.coalesce(strip(col).isin(wanted), F.lit(False)) if wanted else F.lit(True)


def begins_with_any(col: Column, prefixes: list[str]) -> Column:
    """Does the value begin with one of the prefixes?  Null does not."""
    return F.coalesce(reduce(lambda a, b: a | b, [col.startswith(p) for p in prefixes], F.lit(False)), F.lit(False))


def plain_form(col: Column) -> Column:
    """NFKC and trimmed; null gives ''."""
    return strip(nfkc(safe_str(col)))


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; 0 for nothing."""
    return F.when(whole != 0, F.round(part / whole, digits)).otherwise(0.0)


def everyday(expr: Column, name: Column, longest: int = 20) -> Column:
    """Is the expression everyday language for the name?  The rules in their order, as one condition."""
    e, n = safe_str(expr), safe_str(name)
    clinical = (F.length(e) <= 6) & e.rlike(CLINICAL_ENDING)
    polite = reduce(lambda a, b: a | b, [e.endswith(p) for p in POLITE_ENDINGS])
    return (n != "") & (e != "") & (e != n) & ~F.contains(e, n) & (F.length(e) >= 2) & (F.length(e) <= longest) & ~clinical & ~has_any(e, CLINICAL_WORDS) & ~polite
