"""Annotating texts with dictionary entries: tokens, n-grams, nearest entries, assertion, best spans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.operators.similarity import lexical_similarity, short_penalty
from shirabe.operators.spans import Tokenizer, assertion, is_trivial, ngrams, region_flags, select_spans, tokenize, whitespace_tokenizer
from shirabe.operators.vector import hashed_embedding, knn, rerank
from shirabe.session import materialize


def annotate(docs: DataFrame, entries: DataFrame, key: str, text: str, embed: Callable[[Column], Column] = hashed_embedding, tokenizer: Tokenizer = whitespace_tokenizer, max_n: int = 6, top_k: int = 15, least_score: float = 0.70, lexical: bool = True, regions: str | None = None, adjacent_conflicts: bool = False, joiner: str = "") -> DataFrame:
    """``key`` and ``annotations``: array of hpo_id, label, status, evidence, score, entry, begin, end.

    ``entries`` has entry_no, hpo_id, label and expr.  Only distinct span texts are embedded and
    looked up, each once.  With ``lexical`` off the raw score alone decides.  Texts without a span
    that passes, and null texts, get the empty array.
    """
    base = docs.select(key, F.col(text).alias("_text"), *([F.col(regions).alias("_reg")] if regions else []))
    toks = base.withColumn("_tok", tokenize(F.coalesce(F.col("_text"), F.lit("")), tokenizer))
    if regions:
        toks = toks.withColumn("_flag", region_flags(F.col("_tok"), F.col("_reg")))
    grams = ngrams(toks, "_tok", max_n, [key], "_flag" if regions else None, joiner).where(~is_trivial(F.col("span")))
    grams = materialize(grams, "spans")
    spans = materialize(grams.select("span").distinct().withColumn("vec", embed(F.col("span"))), "span-vectors")  # embedded once, however many blocks follow
    table = materialize(entries.withColumn("vec", embed(F.col("expr"))).select("entry_no", "hpo_id", "label", "expr", "vec"), "entries")
    hits = knn(spans, table.select("entry_no", "vec"), top_k, "span", "entry_no", "vec", hold="base")
    full = hits.join(table.drop("vec"), "entry_no")
    if lexical:
        best = rerank(full, "span", "score", lexical_similarity(F.col("span"), F.col("expr")), short_penalty(F.col("span"), F.col("expr")), least_score=least_score, entry_id="hpo_id")
    else:
        whole = F.struct(*full.columns)
        best = full.groupBy("span").agg(F.max_by(whole, F.struct("score", -F.col("rank"))).alias("w")).select("w.*").where((F.col("score") >= least_score) & (F.col("hpo_id") != ""))
    found = grams.join(best.select("span", "hpo_id", "label", "expr", "score"), "span").join(toks.select(key, "_text", "_tok"), key)
    status = assertion(F.col("_text"), F.col("begin"), F.col("end"), F.col("_tok"))
    rows = found.select(key, F.struct("start", "stop", F.col("span").alias("text"), "score", "hpo_id", "label", "expr", status.alias("status"), "begin", "end").alias("s"))
    chosen = select_spans(rows.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("spans")), key, "spans", adjacent_conflicts=adjacent_conflicts)
    shaped = F.transform("chosen", lambda s: F.struct(s["hpo_id"].alias("hpo_id"), s["label"].alias("hpo_label_ja"), s["status"].alias("status"), s["text"].alias("evidence_span"), s["score"].alias("score"), s["expr"].alias("dict_expr"), s["begin"].alias("begin"), s["end"].alias("end")))
    out = chosen.select(key, shaped.alias("annotations"))
    kind = out.schema["annotations"].dataType
    return docs.select(key).join(out, key, "left").select(key, F.coalesce("annotations", F.array().cast(kind)).alias("annotations"))
