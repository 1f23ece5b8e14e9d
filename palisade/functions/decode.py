"""Undoing the encodings attackers hide payloads in, and text normalisation.

All of it is built from Spark expressions, so detection stays inside the JVM.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, functions as F

_NAMED_ENTITIES = json.dumps(
    {name: char for name, char in html.entities.html5.items() if name.endswith(";")}
)


def _utf32(code_point: Column) -> Column:
    """The character of a code point; NULL for surrogates and beyond U+10FFFF."""
    valid = (code_point >= 0) & (code_point <= 0x10FFFF) & ~code_point.between(0xD800, 0xDFFF)
    return F.when(
        valid, F.decode(F.unhex(F.lpad(F.hex(code_point.cast("long")), 8, "0")), "UTF-32")
    )


def _from_hex(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def replace_tokens(text: Column, token: str, replacement) -> Column:
    """Rewrite every match of ``token``; NULL from ``replacement`` keeps it."""
    pieces = F.split(text, token, -1)
    found = F.regexp_extract_all(text, F.lit(token), F.lit(0))
    filled = F.transform(found, lambda t: F.coalesce(replacement(t), t))
    return F.array_join(
        F.zip_with(pieces, filled, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), ""
    )


def url_decode(text: Column) -> Column:
    """Percent-decode; '+' and stray '%' stay, undecodable text stays whole."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(safe)
    broken = decoded.contains("�") & ~text.contains("�")
    return F.when(text.contains("%"), F.when(~broken, decoded).otherwise(text)).otherwise(text)


def html_decode(text: Column) -> Column:
    """Decode numeric and named character references that end in ';'."""

    def char(token):
        body = F.substr(token, F.lit(2))
        digits = F.regexp_replace(body, r"^#[xX]?0*+(?=[0-9a-fA-F])|;$", "")  # leading zeros mean nothing
        numeric = F.when(body.rlike(r"^#[xX]"), F.when(F.length(digits) <= 6, _from_hex(digits)))
        numeric = numeric.when(body.startswith("#"), F.when(F.length(digits) <= 7, digits.try_cast("long")))
        named = F.element_at(F.from_json(F.lit(_NAMED_ENTITIES), "map<string,string>"), body)
        return F.when(body.startswith("#"), _utf32(numeric)).otherwise(named)

    token = r"&(?:#[xX][0-9a-fA-F]++|#[0-9]++|[A-Za-z][A-Za-z0-9]{1,31});"
    return F.when(text.contains("&") & text.rlike(token), replace_tokens(text, token, char)).otherwise(text)


def unicode_decode(text: Column) -> Column:
    token = r"\\u[0-9a-fA-F]{4}"
    return F.when(
        text.contains("\\u"),
        replace_tokens(text, token, lambda t: _utf32(_from_hex(F.substring(t, 3, 4)))),
    ).otherwise(text)


def hex_decode(text: Column) -> Column:
    token = r"\\x[0-9a-fA-F]{2}"
    return F.when(
        text.contains("\\x"),
        replace_tokens(text, token, lambda t: _utf32(_from_hex(F.substring(t, 3, 2)))),
    ).otherwise(text)


def from_char_code_decode(text: Column) -> Column:
    token = r"String\.fromCharCode\s*\(\s*[0-9,\s]+\s*\)"

    def chars(t):
        codes = F.split(F.regexp_extract(t, r"\(([^)]*)\)", 1), ",")
        return F.array_join(
            F.transform(codes, lambda c: F.coalesce(_utf32(F.trim(c).try_cast("long")), F.lit(""))), ""
        )

    return F.when(
        text.contains("String.fromCharCode"), replace_tokens(text, token, chars)
    ).otherwise(text)


def with_decoded_sqli(df, text: str, out: str):
    """URL, entity, ``\\x`` and ``\\u`` decoding for the SQL detector.

    One projection per step: each step reads its input several times, and a
    single nested expression would repeat the earlier steps.
    """
    df = df.withColumn(out, url_decode(F.col(text)))
    df = df.withColumn(out, html_decode(F.col(out)))
    df = df.withColumn(
        out,
        F.when(
            F.col(out).contains("\\x"), url_decode(F.replace(F.col(out), F.lit("\\x"), F.lit("%")))
        ).otherwise(F.col(out)),
    )
    return df.withColumn(out, unicode_decode(F.col(out)))


def with_decoded_xss(df, text: str, out: str):
    """URL decoding up to three times, then every escape the XSS detector knows."""
    df = df.withColumn(out, url_decode(F.col(text)))
    for step in (url_decode, url_decode, html_decode, hex_decode, unicode_decode, from_char_code_decode):
        df = df.withColumn(out, step(F.col(out)))
    return df


def _single_spaced(text: Column) -> Column:
    """Every run of white space as one space; single spaces, which most are, need no replacement."""
    return F.regexp_replace(text, r"\s\s+|[\t\n\x0B\f\r]", " ")


def normalize_sqli(text: Column) -> Column:
    out = _single_spaced(F.lower(text))
    out = F.regexp_replace(out, r"--.*$", "")
    out = F.regexp_replace(out, r"/\*.*?\*/", " ")
    return F.trim(out)


def normalize_xss(text: Column) -> Column:
    out = _single_spaced(F.lower(text))
    out = F.regexp_replace(out, r"<!--.*?-->", "")
    for entity, char in (("&#39;", "'"), ("&#34;", '"'), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def normalize_xss_payload(text: Column) -> Column:
    """The comparison form of a payload: as above, trimmed, entities kept."""
    out = _single_spaced(F.lower(text))
    return F.trim(F.regexp_replace(out, r"<!--.*?-->", ""))
