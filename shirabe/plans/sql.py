"""Pieces of SQL that several counterparts share."""

from __future__ import annotations

import unicodedata

from shirabe.functions import text

# White space as Unicode has it, as a class of SQL regular expressions.
SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SOME = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def some(x: str) -> str:
    """Neither null nor blank."""
    return f"coalesce(regexp_matches({x}, '{SOME}'), FALSE)"


def literal(value: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in value)


def first_line(x: str) -> str:
    return strip(rf"regexp_extract({strip(x)}, '^([^\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]*)', 1)")


def clean_expression(x: str, mode: str, cut_inside: bool = True) -> str:
    cut = r"(?is)assistant[:：]?.*$" if cut_inside else rf"(?i){SPACE}*assistant[:：]?{SPACE}*$"
    out = strip(f"regexp_replace({first_line(f'coalesce({x}, {quoted(str())})')}, '{cut}', '')")
    for p in text.PATIENT_PREFIXES if mode == "patient" else text.DOCTOR_PREFIXES:
        out = f"regexp_replace({out}, '^{literal(p)}{SPACE}*', '')"
    for c in text.CLOSING:
        out = f"regexp_replace({out}, '{SPACE}*{literal(c)}$', '')"
    return out


def clean_label(x: str) -> str:
    out = first_line(f"coalesce({x}, '')")
    for b in text.BULLETS:
        out = f"regexp_replace({out}, '^{literal(b)}{SPACE}*', '')"
    for q in text.EDGE_QUOTES:
        out = rf"regexp_replace({out}, '(?s)^{literal(q)}{SPACE}*(.+?){SPACE}*{literal(q)}$', '\1')"
    return f"regexp_replace({out}, '{SPACE}*。$', '')"


def compare_key(x: str) -> str:
    return f"regexp_replace({strip(f'coalesce({x}, {quoted(str())})')}, '{SPACE}+', ' ', 'g')"


def nfkc_table() -> str:
    """(c, d): every character of the first plane that the compatibility form takes apart, by the standard's own table."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if a != b]
    return f"SELECT unnest([{','.join(quoted(a) for a, _ in pairs)}]) AS c, unnest([{','.join(quoted(b) for _, b in pairs)}]) AS d"


def nfkc(table: str, key: str, column: str) -> str:
    """A query with ``key`` and ``v``: the normal form of every value of ``column``; null for null."""
    return f"""
SELECT {key}, CASE WHEN {column} IS NULL THEN NULL ELSE coalesce(x.v, '') END AS v FROM {table} LEFT JOIN (
  SELECT {key} AS k, nfc_normalize(string_agg(coalesce(m.d, u.c), '' ORDER BY i)) AS v
  FROM (SELECT {key}, i, substr({column}, i, 1) AS c FROM {table}, unnest(range(1, length({column}) + 1)) AS t(i)) u LEFT JOIN ({nfkc_table()}) m ON m.c = u.c GROUP BY 1) x ON x.k = {key}"""
