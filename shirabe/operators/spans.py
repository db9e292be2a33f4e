"""Spans of tokens in a text: tokens with places, n-grams, trivial spans, assertion, best non-overlapping set."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shirabe.functions.text import let

# Signs at the edges of a span.
SPAN_SIGNS = " \t\r\n　、。.,()（）[]【】「」『』:：;；，"
# Particles of which one is taken off the end, in the order they are tried.
PARTICLES = ["について", "によって", "による", "として", "から", "まで", "より", "には", "では", "とは", "にも", "でも", "が", "を", "に", "へ", "と", "で", "は", "も", "の", "や"]
# Single characters that may be a span.
SINGLE_ALLOWED = ["熱", "咳"]
# Words that mean nothing by themselves.
STOP_WORDS = [
    "生後", "出生後", "新生児期", "乳児", "在胎", "妊娠", "分娩", "周産期", "診断", "検査", "受診", "経過", "治療", "施行", "開始", "継続", "確認", "評価", "結果", "所見",
    "MRI", "CT", "レントゲン", "X線", "超音波", "エコー", "低下", "増加", "上昇", "下降", "亢進", "拡大", "縮小", "遷延",
]
# Words of time and circumstance.
TEMPORAL = "^(?:生後|出生後|新生児期|乳児期|幼児期|学童期|思春期|成人期|在胎|妊娠|妊娠中|産後|周産期|分娩)(?:から|より|まで|に|で|頃|ごろ)?$"
# Phrases of context.
STOP_PHRASES = ["後に", "期から", "繰り返し", "導入して", "経過観察", "持続したため", "と診断", "と診断新生児", "があり", "あり、", "疑いで", "を認めた", "を受けている", "で経過観察"]
# Signs of uncertainty and of absence.
UNCERTAIN = ["否定できない", "否定はできない", "可能性[^。]*否定できない"]
ABSENT = ["(所見|異常|症状|問題)なし", "(所見|異常|症状|問題)は?認められない", "(?:は|が)?認められない", "(?:は|が)?見られない", "(?:は|が)?ない", "陰性", "訴え[^。]*なし", "症状なく"]
ABSENT_TOKENS = ["ない", "ありません", "ないです", "無し", "なし", "見られない", "みられない", "認めない", "認められない", "認められず", "所見なし", "異常なし", "症状なし", "問題なし", "問題ない", "陰性"]

TOKENS = T.ArrayType(T.StructType([T.StructField("tok", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))
Tokenizer = Callable[[str], list[tuple[str, int, int]]]


def whitespace_tokenizer(text: str) -> list[tuple[str, int, int]]:
    """Tokens between white space, with character places."""
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]


def script_tokenizer(text: str) -> list[tuple[str, int, int]]:
    """Runs of one script, for text without spaces: a rough stand-in for a morphological analyser."""
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[一-鿿々ヶ]+|[ぁ-ゖ]+|[ァ-ヺー]+|[A-Za-z]+|[0-9０-９.]+|[^\s]", text)]


def tokenize(col: Column, tokenizer: Tokenizer = whitespace_tokenizer) -> Column:
    """array<struct<tok, begin, end>>; null and blank texts give the empty array."""

    @F.pandas_udf(TOKENS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"tok": t, "begin": b, "end": e} for t, b, e in tokenizer(x)] if x else [])

    return run(col)


def joined_tokens(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["tok"]), " ")


Tagger = Callable[[str], list[tuple[str, int, int]]]
REGIONS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def tag_name(tag: str) -> str:
    """A tag without its position: "B-x" and "I-x" are x."""
    return tag[2:] if tag[:2] in ("B-", "I-") else tag


def tag_regions(col: Column, tagger: Tagger | None, allowed: list[str]) -> Column:
    """Character ranges whose tag, without its position, begins with one of ``allowed``: array of begin, end.

    ``tagger`` gives (tag, begin, end) of a text.  Without a tagger, and for null and empty texts, the
    array is empty, which ``region_flags`` reads as "nothing to gate by".
    """

    @F.pandas_udf(REGIONS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"begin": b, "end": e} for t, b, e in tagger(x) if tag_name(t).startswith(tuple(allowed))] if x and tagger else [])

    return run(col)


def region_flags(tokens: Column, regions: Column) -> Column:
    """Per token whether it overlaps one of the allowed character ranges (array of begin, end).

    An empty array of regions allows every token (there was nothing to gate by); null does too.
    """
    gated = F.transform(tokens, lambda t: F.exists(regions, lambda r: (r["begin"] < t["end"]) & (t["begin"] < r["end"])))
    return F.when(regions.isNull() | (F.size(regions) == 0), F.transform(tokens, lambda t: F.lit(True))).otherwise(gated)


def ngrams(df: DataFrame, tokens: str, max_n: int, keep: list[str], flags: str | None = None, joiner: str = "") -> DataFrame:
    """``keep``, ``start``, ``stop`` (token range), ``begin``, ``end`` (characters), ``span``: all n-grams.

    With ``flags`` an n-gram needs one allowed token.  Native expressions; rows grow by max_n per token.
    """
    n = F.size(tokens)
    starts = F.sequence(F.lit(0), n - 1)
    ranges = F.when(n > 0, F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i + 1, F.least(i + max_n, n)), lambda j: F.struct(i.alias("start"), j.alias("stop"))))))
    rows = df.select(*keep, F.col(tokens).alias("_t"), *([F.col(flags).alias("_f")] if flags else []), F.explode(ranges).alias("_r")).select("*", "_r.start", "_r.stop")
    if flags:
        rows = rows.where(F.exists(F.slice("_f", F.col("start") + 1, F.col("stop") - F.col("start")), lambda x: x))
    part = F.slice("_t", F.col("start") + 1, F.col("stop") - F.col("start"))
    return rows.select(*keep, "start", "stop", F.col("_t")[F.col("start")]["begin"].alias("begin"), F.col("_t")[F.col("stop") - 1]["end"].alias("end"), F.array_join(F.transform(part, lambda t: t["tok"]), joiner).alias("span"))


def _bare(col: Column) -> Column:
    cls = "".join(f"\\x{{{ord(c):x}}}" for c in SPAN_SIGNS)
    return F.regexp_replace(col, f"^[{cls}]+|[{cls}]+$", "")


def is_trivial(span: Column, particles: list[str] | None = None, single: list[str] | None = None, words: list[str] | None = None, temporal: str = TEMPORAL, phrases: list[str] | None = None) -> Column:
    """Spans not worth looking up: empty, one character, short kana, stop words, times, phrases.

    One particle is taken off the end first (the first of the list that fits); phrases are tested
    before that.  Null counts as trivial.
    """
    own = particles or PARTICLES

    def without_particle(s: Column) -> Column:
        return reduce(lambda rest, p: F.when(s.endswith(p) & (F.length(s) > len(p)), F.substr(s, F.lit(1), F.length(s) - len(p))).otherwise(rest), reversed(own), s)

    def judged(s: Column) -> Column:
        core = _bare(without_particle(s))
        return let(F.when(core != "", core).otherwise(s), lambda check: (
            (s == "")
            | ((F.length(check) == 1) & ~check.isin(single or SINGLE_ALLOWED))
            | (check.rlike("^[ぁ-ゖー]+$") & (F.length(check) <= 3))
            | check.isin(words or STOP_WORDS)
            | check.rlike(temporal)
            | s.isin(phrases or STOP_PHRASES)
        ))

    return let(_bare(F.trim(F.coalesce(span, F.lit("")))), judged)


def _status(around: Column, denied: Column | None, uncertain: list[str] | None, absent: list[str] | None) -> Column:
    unsure = around.rlike("|".join(f"(?:{p})" for p in uncertain or UNCERTAIN))
    gone = around.rlike("|".join(f"(?:{p})" for p in absent or ABSENT))
    return F.when(unsure, "uncertain").when(gone if denied is None else gone | denied, "absent").otherwise("present")


def assertion(text: Column, begin: Column, end: Column, tokens: Column | None = None, window: int = 20, uncertain: list[str] | None = None, absent: list[str] | None = None, absent_tokens: list[str] | None = None) -> Column:
    """present, absent or uncertain, from the characters around a span; uncertainty goes first."""
    lo = F.greatest(begin - window, F.lit(0))
    hi = F.least(end + window, F.length(text))
    around = F.substr(text, lo + 1, F.greatest(hi - lo, F.lit(0)))
    denied = None if tokens is None else F.exists(tokens, lambda t: (t["end"] > lo) & (t["begin"] < hi) & t["tok"].isin(absent_tokens or ABSENT_TOKENS))
    return _status(around, denied, uncertain, absent)


MENTIONS = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("around", T.StringType()), T.StructField("denied", T.BooleanType())]))


def mentions(text: Column, find: Callable[[str], list[tuple[int, int]]], tokenizer: Tokenizer | None = whitespace_tokenizer, window: int = 20, absent_tokens: list[str] | None = None) -> Column:
    """All spans that ``find`` gives of a text, with the characters around each and whether a token of absence overlaps these.

    For texts with many spans: one Arrow call per batch reads a text once, where ``assertion`` would
    walk to every span anew.  Null texts have none.
    """
    words = set(absent_tokens or ABSENT_TOKENS)

    @F.pandas_udf(MENTIONS)
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return []
            denials = [(b, e) for t, b, e in tokenizer(x) if t in words] if tokenizer else []
            starts = [b for b, _ in denials]
            out = []
            for b, e in find(x):
                lo, hi = max(b - window, 0), min(e + window, len(x))
                at = bisect.bisect_left(starts, hi)  # tokens do not overlap: the last one before hi reaches furthest
                out.append({"begin": b, "end": e, "around": x[lo:hi], "denied": at > 0 and denials[at - 1][1] > lo})
            return out

        return s.map(one)

    return run(text)


def mention_status(mention: Column, uncertain: list[str] | None = None, absent: list[str] | None = None) -> Column:
    """present, absent or uncertain for one element of ``mentions``."""
    return _status(mention["around"], mention["denied"], uncertain, absent)


def best_disjoint(spans: list[tuple[int, int, float]], adjacent_conflicts: bool = False) -> list[int]:
    """Indices of the heaviest set of ranges (start, stop, weight) without overlap, left to right.

    A range must add weight to be taken; ranges sort by stop, then start.
    """
    order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0]))
    stops = [spans[i][1] for i in order]
    gap = 1 if adjacent_conflicts else 0
    best, before = [0.0], []
    for n, i in enumerate(order):
        at = bisect.bisect_right(stops, spans[i][0] - gap, 0, len(stops))
        before.append(at)
        best.append(max(best[n], spans[i][2] + best[min(at, n)]))
    out, n = [], len(order)
    while n:
        i = order[n - 1]
        if spans[i][2] + best[min(before[n - 1], n - 1)] > best[n - 1]:
            out.append(i)
            n = min(before[n - 1], n - 1)
        else:
            n -= 1
    return out[::-1]


def select_spans(df: DataFrame, key: str, spans: str, alpha: float = 0.15, beta: float = 0.05, adjacent_conflicts: bool = False, out: str = "chosen") -> DataFrame:
    """``key`` and the chosen spans of each row's array<struct<start, stop, text, score, ...>>.

    Weight is score + alpha log(1 + characters) + beta tokens.  One Arrow call per batch; a row's
    array is that of one text.  Null arrays count as empty.
    """
    kind = df.schema[spans].dataType

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def pick(s: pd.Series) -> pd.Series:
        def one(rows):
            if rows is None:
                return []
            triples = [(int(r["start"]), int(r["stop"]), float(r["score"]) + alpha * math.log1p(len(r["text"] or "")) + beta * max(1, int(r["stop"]) - int(r["start"]))) for r in rows]
            return best_disjoint(triples, adjacent_conflicts)

        return s.map(one)

    slim = F.transform(spans, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"), r["text"].alias("text"), r["score"].cast("double").alias("score")))
    chosen = df.select(key, spans, pick(slim).alias("_i"))
    return chosen.select(key, F.coalesce(F.transform("_i", lambda i: F.col(spans)[i]), F.array().cast(kind)).alias(out))
