"""Scores out of a model's free-form verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shirabe.functions.text import let, strip

# The keys of a verdict.
FIELDS = {"match": "match_score", "simplicity": "simplicity_score", "overall": "overall_score"}
TECHNICAL, COMMENT = "too_technical", "comment"


def json_candidates(raw: Column, outermost: bool = True) -> list[Column]:
    """The places where the object may stand, in the order they are tried."""
    fence = F.regexp_extract(raw, r"(?s)```json(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1) if outermost else F.regexp_extract(raw, r"(?s)^.*(\{.*\})", 1)
    return [raw, fence, braces]


def last_json(raw: Column, outermost: bool = True) -> Column:
    """The verdict as VARIANT: the whole text, else a fenced block, else the braces; null if none parses."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.try_parse_json(c)) for c in json_candidates(raw, outermost)])


def parse_verdict(raw: Column, strict_keys: bool = False) -> Column:
    """struct(match, simplicity, overall, too_technical, comment, how) with how = json, text or failed.

    Where no JSON object parses, single values are read from the text (1 to 5, default 1); unless
    ``strict_keys``, a quoted key counts too.  "false" as a text is false.  A null verdict has failed.
    """
    keys = [*FIELDS.values(), TECHNICAL, COMMENT]
    chosen = F.coalesce(*[F.when((F.trim(c) != "") & F.try_parse_json(c).isNotNull(), strip(c)) for c in json_candidates(raw)])
    quote = "" if strict_keys else "[\"']?"

    def from_object(text: Column) -> Column:
        # one parse of the object; every value as text, so that "false" and false are alike
        return let(F.from_json(text, ", ".join(f"{k} string" for k in keys)), lambda o: F.struct(
            *[F.coalesce(o[key].try_cast("double").try_cast("int"), F.lit(0)).alias(name) for name, key in FIELDS.items()],
            F.coalesce(F.lower(o[TECHNICAL]).isin("true", "1", "真", "yes"), F.lit(False)).alias("too_technical"),
            F.coalesce(o[COMMENT], F.lit("")).alias("comment"), F.lit("json").alias("how")))

    def number(key: str) -> Column:
        return F.coalesce(F.regexp_extract(raw, rf"{key}{quote}\s*[:＝：=]\s*[\"']?([1-5])", 1).try_cast("int"), F.lit(1))

    word = F.lower(F.regexp_extract(raw, rf"(?i){TECHNICAL}{quote}\s*[:＝：=]\s*[\"']?(true|false|真|偽)", 1))
    remark = F.regexp_extract(raw, rf"{COMMENT}{quote}\s*[:＝：=]\s*\"([^\"]{{0,50}})\"", 1)
    by_text = F.struct(*[number(key).alias(name) for name, key in FIELDS.items()], word.isin("true", "真").alias("too_technical"), remark.alias("comment"), F.lit("text").alias("how"))
    none = F.struct(*[F.lit(1).alias(n) for n in FIELDS], F.lit(True).alias("too_technical"), F.lit("").alias("comment"), F.lit("failed").alias("how"))
    return F.when(raw.isNull(), none).otherwise(let(chosen, lambda c: F.when(F.coalesce(c.startswith("{"), F.lit(False)), from_object(c)).otherwise(by_text)))


def good_verdict(match: Column, simplicity: Column, overall: Column, technical: Column, least_overall: int, least_match: int, least_simplicity: int) -> Column:
    return (overall >= least_overall) & (match >= least_match) & (simplicity >= least_simplicity) & ~technical
