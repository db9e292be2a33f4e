"""Template residue, filler, pending notes, error pages and page controls in place of content.

Everything is one column expression in the JVM: full-width signs are folded to ASCII, then each
kind of slot has a grammar of its own delimiters, and each kind of notice its patterns.  The same
rules hold at every length.  Code is taken out unless nothing else is there; a slot that a sentence
explains (words of explanation beside it) is taken out too; what is left to match must make up
``density`` of the text, so a tutorial that shows a placeholder is not residue.  Phrases that a real
sentence may hold as well (``TOPICS``) must make up ``topic_density``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shirabe.functions.text import let

# Words that name what a slot stands for, where the delimiters alone do not tell.
SLOT_WORDS = "placeholder|label|name|title|text|value|term|symptom|insert|fill|日本語名|和名|病名|名称|ラベル|訳語|訳文|記入|入力|ここに|未設定|プレースホルダ"
# One grammar per pair of delimiters.
SLOTS = [
    r"\{\{[^{}]*\}\}", r"\{%[^{}]*%\}", r"[$#]\{[^{}]*\}", r"<%[^<>]*%>", r"\[\[[^\[\]]*\]\]", r"\$\([A-Za-z_][\w.]*\)",
    r"%(?:[A-Za-z_][\w.]*|[^%\s]*(?:" + SLOT_WORDS + r")[^%\s]*)%",
    r"__(?:[A-Za-z][\w.]*?|[^_\s]*(?:" + SLOT_WORDS + r")[^_\s]*)__",
    r"<(?!/?(?:sub|sup|br|b|i|em|strong|p|span)\b)(?:[A-Za-z_][\w.]*_[\w.]*|[A-Za-z_]+\.[A-Za-z_.]+|[^<>/]*(?:" + SLOT_WORDS + r")[^<>/]*)>",
    r"[【\[]\s*(?:[A-Za-z]+[_.][\w.]*|[^【】\[\]]*(?:" + SLOT_WORDS + r")[^【】\[\]]*)\s*[】\]]",
    r"\{(?:" + SLOT_WORDS + r")[\w.]*\}",
]
# Filler and dummy text.
FILLERS = [
    r"(?i:lorem\s+ipsum)", r"ダミー(?:テキスト|文字|データ|です)?", r"(?:サンプル|テスト)(?:文字列|テキスト|データ|入力|です)", r"テストテスト", r"てすと", r"ここに.{0,8}(?:入り|入れ|記入|入力|回答)",
    r"あいうえお", r"(?:ほげ|hoge|foo\s?bar|asdf|qwerty)", r"([\p{L}○〇●×＊*?？])\1{4,}", r"[○〇●◯]{2,}", r"(?:x{2,}|X{2,})性", r"(?:^|[^A-Za-z])[xX]{3,}(?:$|[^A-Za-z])", r"^[\s・。\-_=*.]{3,}$",
]
# Notes that the label is still to be written.
PENDING = [
    r"(?:^|[^A-Za-z])(?:TODO|FIXME|TBD|TBA|WIP|XXX)(?:$|[^A-Za-z])", r"要(?:記入|入力|翻訳|和訳)", r"未(?:記入|入力|翻訳|訳|定稿)(?:$|[^\p{L}])", r"(?:和訳|翻訳|訳語|日本語名|ラベル)(?:は|を)?(?:後日|後で|あとで|未定|準備中|待ち|検討中|確認中)",
    r"仮(?:ラベル|名称|訳)", r"^\W*[(]仮[)]\W*\d*$", r"後で(?:直す|書く|入れる|修正)", r"準備中です",
]
# Error, status and script notices.
ERRORS = [
    r"(?i)(?:^|\D)[45]\d\d\s*(?:not found|forbidden|unauthorized|bad (?:gateway|request)|(?:internal )?server error|internal error|service (?:temporarily )?unavailable|gateway time-?out|gone|too many requests|error)",
    r"(?i)access denied|permission denied|connection (?:refused|reset|timed out)|request timed out|page not found|null ?pointer|traceback \(most|stack ?trace|exception in thread",
    r"(?:^|[^A-Za-z])(?:undefined|NaN|null|NULL|None|nil)(?:$|[^A-Za-z])", r"undefined(?:undefined|\d|。)", r"\[object \w+\]", r"(?:接続|通信|処理|応答)が?(?:タイムアウト|切れ|できません)", r"タイムアウトしました", r"(?:表示|接続|取得|処理|実行|検索)でき(?:ません|ませんでした)", r"応答(?:しません|がありません)",
    r"(?:削除|移動)され(?:た|て)(?:か|いる|います)", r"(?:見つかり|存在し)ません", r"結果は\s*\d+\s*件", r"エラーが(?:発生|起き)", r"^\W*エラー\s*[|:：]", r"有効期限が切れ", r"再度お試し", r"しばらく(?:して|待って|お待ち)", r"<title>",
    r"権限がありません\W*(?:\W\d|$)", r"アクセスが集中して(?:います|おります)", r"(?i)(?:enable|allow|requires?|activate|turn(?:ing)? on|without)\s+java\s?script|java\s?script\s*(?:が|を|は|to be|is|must be|has been)?\s*(?:disabled|required|enabled|turned|必要|無効|有効|オフ|オン|使え|使用|許可)",
    r"(?i)<\/?noscript", r"(?i)enable (?:cookies|scripts?)|please enable|cookies? (?:must|is|are)", r"スクリプトを(?:有効|使|オン|許可)", r"(?:Cookie|クッキー)と?(?:スクリプト)?を", r"有効にして(?:ください|から)", r"再読み込みして",
]
# Controls and notices of a web page or tool.
CONTROLS = [
    r"シェアする", r"広告を(?:非表示|表示|閉じる)", r"会員登録(?:後|して|が必要|はこちら)", r"続きは(?:会員|こちら|ログイン)", r"続きを読む", r"アプリで開く", r"(?:音声|動画)を再生", r"ログイン(?:して|が必要|はこちら)", r"(?:単語帳|お気に入り|ブックマーク)に(?:保存|追加|登録)", r"翻訳結果\s*[:：]", r"以下に.{0,12}(?:示し|記載し|記し)ます", r"^\W*(?:ホーム|トップページ|メニュー|前へ|次へ|もっと見る|すべて表示|コピーする|閉じる|印刷する)\W*$", r"(?i)(?:sign|log) in to|subscribe to|click here|read more|all rights reserved|share this",
]
# Phrases of notices that a real sentence may hold as well.
TOPICS = [r"権限がありません", r"メンテナンス中", r"アクセスが集中", r"(?i)java\s?script", r"利用規約", r"プライバシーポリシー"]
# Words that explain a slot, before it and after it.
EXPLAINS_BEFORE = r"例えば|たとえば|書式|記法|構文|差し込み|プレースホルダー?の|テンプレートの|(?i:for example|e\.g\.|such as|syntax|written as)"
EXPLAINS_AFTER = r"のように|などと書|と書[くきけい]|と記述|を置き換え|に置換|を置換|が展開|という(?:記法|書式|構文)|(?i:is replaced|will be replaced|expands to|stands for)"
KINDS = {"slot": SLOTS, "filler": FILLERS, "pending": PENDING, "error": ERRORS, "control": CONTROLS, "topic": TOPICS}
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_CODE = r"(?s)```.*?```|(?m)^(?: {4}|\t).*$|`[^`\n]+`"


def _any(patterns: list[str]) -> str:
    return "(?:" + ")|(?:".join(patterns) + ")"


def folded(col: Column) -> Column:
    """Full-width signs as ASCII, trimmed; code is taken out if there is prose beside it."""
    plain = F.regexp_replace(F.translate(col, _WIDE, _PLAIN), r"(?U)^\s+|\s+$", "")
    prose = F.regexp_replace(F.regexp_replace(plain, _CODE, " "), r"(?U)^\s+|\s+$", "")
    return F.when(prose.rlike(r"[\p{L}\p{N}]"), prose).otherwise(plain)


def residue_kind(col: Column, density: float = 0.02, topic_density: float = 0.3) -> Column:
    """The first kind of residue in the text, else null; null, empty and blank texts have none.

    The matches of a kind must make up ``density`` of the characters (``topic_density`` for
    phrases that real sentences hold too), at every length alike.
    """

    def judged(text: Column) -> Column:
        slot = _any(SLOTS)
        told = rf"(?:{EXPLAINS_BEFORE})[^。\n]{{0,15}}?(?:{slot})|(?:{slot})[^。\n]{{0,15}}?(?:{EXPLAINS_AFTER})"
        chain = None
        for kind, patterns in KINDS.items():
            p = ("(?i)" if kind == "slot" else "") + _any(patterns)
            own = F.regexp_replace(text, "(?i)" + told, "") if kind == "slot" else text
            share = density if kind != "topic" else topic_density
            enough = F.length(own) - F.length(F.regexp_replace(own, p, "")) >= F.length(text) * share
            hit = own.rlike(p) & enough
            name = F.lit("control" if kind == "topic" else kind)
            chain = F.when(hit, name) if chain is None else chain.when(hit, name)
        return chain

    return let(folded(col), judged)


def find_residue(df: DataFrame, text: str, kind: str = "kind", density: float = 0.02) -> DataFrame:
    """Rows of ``df`` whose ``text`` is or contains residue, with its ``kind``."""
    return df.withColumn(kind, residue_kind(F.col(text), density)).where(F.col(kind).isNotNull())


def without_residue(df: DataFrame, text: str, density: float = 0.02) -> DataFrame:
    """Rows of ``df`` without residue; rows with a null text stay."""
    return df.where(residue_kind(F.col(text), density).isNull())
