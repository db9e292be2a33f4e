"""Chat examples: building messages, rendering them, cutting them into input and target."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.functions.text import shorten, strip

MESSAGES = "array<struct<role:string,content:string>>"
# Control tokens of the header-style chat template.
BEGIN, HEAD, HEAD_END, TURN_END = "<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"
IGNORED = -100


def message(role: str, content: Column | str) -> Column:
    body = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), body.alias("content"))


def messages(*parts: Column) -> Column:
    return F.array(*parts)


def expression_prompt(name: Column, definition: Column, ask: str, system: str, name_word: str = "名称", definition_word: str = "説明") -> Column:
    """System and user message; the definition block only where there is a definition."""
    head = F.concat(F.lit(f"{ask}\n{name_word}: "), name)
    full = F.when(definition.rlike(r"(?U)\S"), F.concat(head, F.lit(f"\n{definition_word}: "), definition)).otherwise(head)
    return messages(message("system", system), message("user", full))


def _filled(template: str, **parts: Column) -> Column:
    """A template with {name} places as one expression."""
    pieces = re.split(r"(\{\w+\})", template)
    return F.concat(*[parts[x[1:-1]] if x.startswith("{") and x[1:-1] in parts else F.lit(x) for x in pieces if x])


def _or_none(col: Column, none: str = "(なし)") -> Column:
    return F.when(col.rlike(r"(?U)\S"), col).otherwise(F.lit(none))


def judge_prompt(name: Column, definition: Column, expression: Column, system: str = "医学用語と言い換えの対応を採点する係です。", ask: str = "名称: {name}\n説明: {definition}\n表現: {expression}\n一致、平易さ、総合を1から5で採点し、JSONだけを返してください。") -> Column:
    """Messages that ask for a verdict on one expression; a missing definition is named as missing."""
    return messages(message("system", system), message("user", _filled(ask, name=name, definition=_or_none(definition), expression=expression)))


def refine_prompt(name: Column, definition: Column, expression: Column, comment: Column, system: str = "症状を言い換える係です。", ask: str = "名称: {name}\n説明: {definition}\n今の表現: {expression}\n指摘: {comment}\n指摘を直した表現を一行で返してください。") -> Column:
    """Messages that ask for a better expression, given what was wrong with the last one."""
    return messages(message("system", system), message("user", _filled(ask, name=name, definition=_or_none(definition), expression=expression, comment=_or_none(comment))))


def label_prompt(name_en: Column, definition: Column, synonyms: Column, most_synonyms: int = 5, longest: int = 400, system: str = "医学用語を和訳する係です。", ask: str = "英名: {name}\n同義語: {synonyms}\n説明: {definition}\n日本語の標準的な名称を一つだけ返してください。") -> Column:
    """Messages that ask for a label: the first synonyms only, a long definition shortened."""
    listed = F.array_join(F.slice(F.coalesce(synonyms, F.array().cast("array<string>")), 1, most_synonyms), ", ")
    return messages(message("system", system), message("user", _filled(ask, name=name_en, synonyms=_or_none(listed), definition=shorten(definition, longest, default="(なし)"))))


def translation_prompt(text: Column, system: str = "医学文を和訳する係です。", ask: str = "次の文を日本語に訳してください。\n{text}") -> Column:
    """Messages that ask for the translation of one text."""
    return messages(message("system", system), message("user", _filled(ask, text=text)))


def render_roles(msgs: Column) -> Column:
    """``ROLE: content`` lines and a final ``ASSISTANT:``."""
    lines = F.transform(msgs, lambda m: F.concat(F.upper(F.coalesce(m["role"], F.lit("user"))), F.lit(": "), F.coalesce(m["content"], F.lit(""))))
    return F.concat_ws("\n", lines, F.lit("ASSISTANT:"))


def render_headers(msgs: Column, generate: bool = False) -> Column:
    """The header-token template; with ``generate`` it ends where the answer begins."""
    turns = F.transform(msgs, lambda m: F.concat(F.lit(HEAD), F.coalesce(m["role"], F.lit("")), F.lit(HEAD_END + "\n\n"), F.coalesce(m["content"], F.lit("")), F.lit(TURN_END)))
    body = F.concat(F.lit(BEGIN), F.array_join(turns, ""))
    return F.concat(body, F.lit(f"{HEAD}assistant{HEAD_END}\n\n")) if generate else body


def flatten(msgs: Column) -> Column:
    """struct(text_input, output): turns before the last answer, and that answer.

    The last turn of role assistant or model is the target; without one both are empty.  Earlier
    turns with empty content are left out, a missing role counts as user.
    """
    roles = F.transform(msgs, lambda m: F.coalesce(m["role"], F.lit("")).isin("assistant", "model").cast("int"))
    last = F.size(msgs) - F.array_position(F.reverse(roles), 1).cast("int") + 1
    has = F.coalesce(F.array_position(roles, 1) > 0, F.lit(False))
    before = F.filter(F.slice(msgs, F.lit(1), F.greatest(last - 1, F.lit(0))), lambda m: F.coalesce(m["content"], F.lit("")) != "")
    text = strip(F.array_join(F.transform(before, lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), m["content"])), "\n"))
    target = strip(F.coalesce(F.try_element_at(msgs, F.when(has, last).otherwise(F.lit(1)))["content"], F.lit("")))
    return F.struct(F.when(has, text).otherwise(F.lit("")).alias("text_input"), F.when(has, target).otherwise(F.lit("")).alias("output"))


def masked_labels(prompt_len: Column, ids: Column, width: Column) -> Column:
    """Labels of a training example: the prompt's places and the padding up to ``width`` are ignored."""
    own = F.transform(ids, lambda x, i: F.when(i < prompt_len, F.lit(IGNORED)).otherwise(x))
    return F.concat(own, F.array_repeat(F.lit(IGNORED), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def collate(df: DataFrame, prompt: str, full: str, encode: Callable[[str], list[int]], group: str, pad: int = 0, longest: int | None = None) -> DataFrame:
    """Adds ``input_ids``, ``attention_mask`` and ``labels``, padded on the right to the longest row of ``group``.

    ``encode`` is any tokenizer; ids beyond ``longest`` are cut.  Labels of the prompt's ids and of
    the padding are ignored.  Null texts count as empty.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda x: encode(x or "")[:longest])

    rows = df.withColumn("_p", F.size(ids(F.col(prompt)))).withColumn("_i", ids(F.col(full)))
    width = rows.groupBy(F.col(group).alias("_g")).agg(F.max(F.size("_i")).alias("_w"))
    joined = rows.join(width, F.col(group).eqNullSafe(F.col("_g")))
    space = (F.col("_w") - F.size("_i")).cast("int")
    out = joined.withColumn("input_ids", F.concat("_i", F.array_repeat(F.lit(pad), space))).withColumn("attention_mask", F.concat(F.transform("_i", lambda x: F.lit(1)), F.array_repeat(F.lit(0), space)))
    return out.withColumn("labels", masked_labels(F.col("_p"), F.col("_i"), F.col("_w"))).drop("_p", "_i", "_g", "_w")
