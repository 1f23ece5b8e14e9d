"""SQL injection and cross-site scripting detection on text columns.

Each detector adds its columns in layers (decoded, normalised, rule hits,
verdict); a layer reads the one before several times, so Spark keeps the
layers apart and every regular expression runs once per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions import dimensions as D, rules as R
from palisade.functions.decode import normalize_sqli, normalize_xss, with_decoded_sqli, with_decoded_xss
from palisade.functions.text import contains_any, distinct_lower, extract_all, found, names_matching, settle


def detection_text(events: DataFrame) -> Column:
    """What the detectors read of an event: message and parsed fields."""
    return F.concat_ws(" ", "raw_message", F.to_json("parsed"))


def rule_marks(text: Column) -> Column:
    """Which of the characters that rules need occur in ``text``."""
    return F.struct(*[text.contains(mark).alias(mark) for mark in R.RULE_MARKS])


def rule_hits(text: Column, rules: list[R.Rule], lower_cased: bool = False, marks: Column | None = None) -> Column:
    """``array<struct<name, confidence, attack_type, scope>>`` in rule order.

    On lower-cased text a rule is only tried where one of its literals occurs,
    with ``marks`` (the text's ``rule_marks``) only where its character does.
    """

    def matches(rule: R.Rule) -> Column:
        tried = text.rlike(rule.regex)
        literals = R.RULE_LITERALS.get(rule.name) if lower_cased else None
        mark = R.RULE_MARK.get(rule.name) if marks is not None else None
        if literals and literals != [mark]:
            tried = reduce(lambda a, b: a | b, [text.contains(w) for w in literals]) & tried
        return tried if mark is None else marks[mark] & tried

    return F.array_compact(F.array(*[
        F.when(matches(r), F.struct(
            F.lit(r.name).alias("name"), F.lit(r.confidence).alias("confidence"),
            F.lit(r.attack_type).alias("attack_type"), F.lit(r.scope).cast("string").alias("scope")))
        for r in rules
    ]))


def _total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["confidence"])


def _distinct(hits: Column, field: str) -> Column:
    return F.array_distinct(F.transform(hits, lambda h: h[field]))


def _has_any(values: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted]))


def _advice(values: Column, table: dict[str, list[str]]) -> Column:
    lookup = F.create_map(*[
        x for k, texts in table.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in texts]))
    ])
    none = F.array().cast("array<string>")
    return F.flatten(F.transform(values, lambda v: F.coalesce(F.try_element_at(lookup, v), none)))


def _texts(texts: list[str], when: Column | None = None) -> Column:
    value = F.array(*[F.lit(t) for t in texts])
    return value if when is None else F.when(when, value).otherwise(F.array().cast("array<string>"))


def _with_verdict(df: DataFrame, out: str, verdict: dict[str, Column]) -> DataFrame:
    """Add the struct ``out``; what of it nobody reads is not worked out, since its fields are settled one by one."""
    df = df.withColumns({f"_verdict_{name}": settle(value) for name, value in verdict.items()})
    return df.withColumn(out, F.struct(*[F.col(f"_verdict_{name}").alias(name) for name in verdict])).drop(*[f"_verdict_{name}" for name in verdict])


# --- SQL injection ----------------------------------------------------------

def sqli_bypass(normalized: Column) -> Column:
    """0.1 per filter-evasion mark, at most 0.3."""
    marks = sum((found(normalized, p).cast("int") for p in R.SQLI_BYPASSES), F.lit(0))
    return F.least(marks * 0.1, F.lit(0.3))


def sqli_payload(original: Column, decoded: Column) -> Column:
    """``struct<encodings, keywords, special_chars, comments, quotes>``."""
    return F.struct(
        names_matching(original, R.SQLI_ENCODINGS).alias("encodings"),
        F.transform(extract_all(decoded, R.SQL_WORDS), F.lower).alias("keywords"),
        F.array_distinct(extract_all(decoded, R.SQL_SPECIAL_CHARS, 0)).alias("special_chars"),
        F.array_compact(F.array(
            F.when(decoded.contains("--"), "line_comment"),
            F.when(decoded.contains("/*") & decoded.contains("*/"), "block_comment"),
            F.when(decoded.contains("#"), "hash_comment"))).alias("comments"),
        F.array_compact(F.array(
            F.when(decoded.contains("'"), "single_quote"), F.when(decoded.contains('"'), "double_quote"),
            F.when(decoded.contains("`"), "backtick"))).alias("quotes"),
    )


def sqli_risk(confidence: Column, attack_types: Column, dangerous: Column, encodings: Column) -> Column:
    factors = (
        (F.size(attack_types) > 2).cast("int") + dangerous.cast("int") * 2
        + (F.size(encodings) > 1).cast("int") + F.array_contains(attack_types, "Time").cast("int")
    )
    return _risk_from(confidence, factors, 0.5)


def _risk_from(confidence: Column, factors: Column, medium: float) -> Column:
    return (
        F.when(confidence >= 0.9, "Critical").when(confidence >= 0.7, "High")
        .when(factors >= 4, "Critical").when(factors >= 2, "High")
        .when(confidence >= medium, "Medium").otherwise("Low")
    )


def sqli_mitigations(attack_types: Column, encodings: Column) -> Column:
    return F.concat(
        _texts(D.SQLI_GENERAL_ADVICE), _advice(attack_types, D.SQLI_TYPE_ADVICE),
        _texts(D.SQLI_ENCODING_ADVICE, F.size(encodings) > 0))


_SQL_DANGEROUS = r"(?i)\b(" + "|".join(w for w in R.SQL_DANGEROUS_WORDS if w in R.SQL_WORDS) + r")\b"


def sqli_detect(df: DataFrame, text: Column, out: str = "sqli", payload: bool = False) -> DataFrame:
    """Add ``out``: verdict, confidence, types, matched rules, risk, advice.

    With ``payload`` the struct of ``sqli_payload`` comes as ``<out>_payload``.
    """
    df = df.withColumn("_text", settle(text))
    df = with_decoded_sqli(df, "_text", "_decoded")
    df = df.withColumn("_norm", normalize_sqli(F.col("_decoded")))
    df = df.withColumn("_marks", rule_marks(F.col("_norm")))
    df = df.withColumns({
        "_hits": rule_hits(F.col("_norm"), R.SQLI_RULES, lower_cased=True, marks=F.col("_marks")),
        "_bypass": sqli_bypass(F.col("_norm")),
        "_enc": names_matching(F.col("_text"), R.SQLI_ENCODINGS),
    })
    n = F.size("_hits")
    df = df.withColumns({
        "_conf": F.when(n > 0, F.least((_total(F.col("_hits")) + F.col("_bypass")) / n, F.lit(1.0))).otherwise(F.lit(0.0)),
        "_types": _distinct(F.col("_hits"), "attack_type"),
    })
    verdict = {
        "detected": F.col("_conf") >= 0.3, "confidence": F.col("_conf"),
        "attack_types": F.col("_types"), "matched": F.transform("_hits", lambda h: h["name"]),
        "encodings": F.col("_enc"),
        "risk_level": sqli_risk(F.col("_conf"), F.col("_types"), F.col("_decoded").rlike(_SQL_DANGEROUS), F.col("_enc")),
        "mitigations": sqli_mitigations(F.col("_types"), F.col("_enc")),
    }
    df = _with_verdict(df, out, verdict)
    if payload:
        df = df.withColumn(out + "_payload", settle(sqli_payload(F.col("_text"), F.col("_decoded"))))
    return df.drop("_text", "_decoded", "_norm", "_marks", "_hits", "_bypass", "_enc", "_conf", "_types")


# --- cross-site scripting ---------------------------------------------------

def xss_bypass(normalized: Column) -> Column:
    """Names of evasion techniques, one per matching mark.

    Every mark of a normalised (lower-case) text holds one of two words.
    """
    possible = normalized.contains("script") | normalized.contains("alert")
    return F.when(possible, names_matching(normalized, R.XSS_BYPASSES)).otherwise(F.array().cast("array<string>"))


def xss_contexts(normalized: Column) -> Column:
    """Page contexts the text shows signs of; the plainer pattern goes first."""
    needs = {"HtmlContent": ["<"], "HtmlAttribute": ["="], "CssStyle": [":", "@"]}

    def shows(name: str, first: str, second: str) -> Column:
        sign = R.XSS_CONTEXT_SIGNS.get(name)
        tried = normalized.rlike(sign) if sign else normalized.rlike(second) | normalized.rlike(first)
        literals = [normalized.contains(w) for w in needs.get(name, [])]
        return reduce(lambda x, y: x | y, literals) & tried if literals else tried

    return F.array_compact(F.array(*[
        F.when(shows(name, first, second), F.lit(name)) for name, (first, second) in R.XSS_CONTEXTS]))


def xss_payload(original: Column, decoded: Column) -> Column:
    """What an XSS payload is made of, as a struct of string arrays."""
    low = F.lower(decoded)
    schemes = F.concat(
        distinct_lower(decoded, R.URL_SCHEME),
        _texts(["javascript"], low.contains("javascript:")), _texts(["data"], low.contains("data:")))
    return F.struct(
        names_matching(original, R.XSS_ENCODINGS).alias("encodings"),
        distinct_lower(decoded, R.HTML_TAG).alias("html_tags"),
        distinct_lower(decoded, R.JS_EVENT, prefix="on").alias("events"),
        distinct_lower(decoded, R.JS_FUNCTION).alias("functions"),
        distinct_lower(decoded, R.CSS_PROPERTY).alias("css_properties"),
        schemes.alias("url_schemes"),
        F.array_distinct(extract_all(decoded, R.XSS_SPECIAL_CHARS, 0)).alias("special_chars"),
        F.array_compact(F.array(
            F.when(decoded.contains("String.fromCharCode"), "fromcharcode"),
            F.when(decoded.contains("eval("), "eval"),
            F.when(original.rlike(r"\\x[0-9a-fA-F]{2}"), "hex_encoding"),
            F.when(original.rlike(r"&#x?[0-9]+;"), "html_entities"),
            F.when(decoded.contains("/*") & decoded.contains("*/"), "comment_hiding"),
        )).alias("obfuscation"),
    )


def xss_signs(original: Column, decoded: Column) -> Column:
    """What risk and advice need to know of a payload, without listing its parts."""
    names = [f.replace(".", r"\.") for f in R.XSS_DANGEROUS_FUNCTIONS]
    return F.struct(
        names_matching(original, R.XSS_ENCODINGS).alias("encodings"),
        (decoded.contains("(") & decoded.rlike(R.JS_FUNCTION)).alias("function"),
        (decoded.contains("(") & decoded.rlike(r"(?i)\b(" + "|".join(names) + r")\s*\(")).alias("dangerous_function"),
        (decoded.contains("<") & decoded.rlike(r"(?i)<\s*(" + "|".join(R.XSS_DANGEROUS_TAGS) + r")(?![a-z])")).alias("dangerous_tag"),
        (decoded.contains("://") & decoded.rlike(r"(?i)\b(" + "|".join(R.XSS_EXTERNAL_SCHEMES) + r")://")).alias("external_scheme"),
        (
            decoded.contains("String.fromCharCode") | decoded.contains("eval(")
            | ((original.contains("\\x") | original.contains("&#")) & original.rlike(r"\\x[0-9a-fA-F]{2}|&#x?[0-9]+;")) | (decoded.contains("/*") & decoded.contains("*/"))
        ).alias("obfuscated"),
    )


def xss_risk(confidence: Column, attack_types: Column, signs: Column) -> Column:
    factors = (
        signs["dangerous_function"].cast("int") * 2 + (F.size(signs["encodings"]) > 1).cast("int")
        + _has_any(attack_types, ["Dom", "PrototypePollution"]).cast("int")
        + signs["dangerous_tag"].cast("int") + signs["external_scheme"].cast("int")
    )
    return _risk_from(confidence, factors, 0.4)


def xss_mitigations(attack_types: Column, contexts: Column, signs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(
        _texts(D.XSS_GENERAL_ADVICE), _advice(attack_types, D.XSS_TYPE_ADVICE),
        _advice(contexts, D.XSS_CONTEXT_ADVICE),
        _texts(D.XSS_ENCODING_ADVICE, F.size(signs["encodings"]) > 0),
        _texts(D.XSS_FUNCTION_ADVICE, signs["function"]),
        _texts(D.XSS_OBFUSCATION_ADVICE, signs["obfuscated"]))))


def xss_detect(df: DataFrame, text: Column, out: str = "xss", payload: bool = False) -> DataFrame:
    """Add ``out``: verdict, confidence, types, contexts, rules, bypasses, risk, advice."""
    df = df.withColumn("_text", settle(text))
    df = with_decoded_xss(df, "_text", "_decoded")
    df = df.withColumn("_norm", normalize_xss(F.col("_decoded")))
    df = df.withColumn("_marks", rule_marks(F.col("_norm")))
    df = df.withColumns({
        "_hits": rule_hits(F.col("_norm"), R.XSS_RULES, lower_cased=True, marks=F.col("_marks")),
        "_bypass": xss_bypass(F.col("_norm")),
        "_shown": xss_contexts(F.col("_norm")),
        "_signs": settle(xss_signs(F.col("_text"), F.col("_decoded"))),
    })
    df = df.withColumns({
        "_types": _distinct(F.col("_hits"), "attack_type"),
        "_rule_ctx": _distinct(F.col("_hits"), "scope"),
    })
    df = df.withColumn("_new", F.array_except("_shown", "_rule_ctx"))
    n = F.size("_hits")
    score = (_total(F.col("_hits")) + F.size("_bypass") * 0.1 + F.size("_new") * 0.1) / (n + 1.0)
    df = df.withColumns({
        "_conf": F.when(n > 0, F.least(score, F.lit(1.0))).otherwise(F.lit(0.0)),
        "_ctx": F.concat("_rule_ctx", "_new"),
    })
    verdict = {
        "detected": F.col("_conf") >= 0.25, "confidence": F.col("_conf"),
        "attack_types": F.col("_types"), "contexts": F.col("_ctx"),
        "matched": F.transform("_hits", lambda h: h["name"]), "bypasses": F.col("_bypass"),
        "risk_level": xss_risk(F.col("_conf"), F.col("_types"), F.col("_signs")),
        "mitigations": xss_mitigations(F.col("_types"), F.col("_ctx"), F.col("_signs")),
    }
    df = _with_verdict(df, out, verdict)
    if payload:
        df = df.withColumn(out + "_payload", settle(xss_payload(F.col("_text"), F.col("_decoded"))))
    return df.drop(
        "_text", "_decoded", "_norm", "_marks", "_hits", "_bypass", "_shown", "_signs", "_types", "_rule_ctx", "_new", "_conf", "_ctx")


def xss_known_bypass(text: Column) -> Column:
    chain = F
    for name, pattern in R.XSS_KNOWN_PAYLOADS:
        chain = chain.when(text.rlike(pattern), name)
    return chain


def xss_quick(text: Column) -> Column:
    first, *rest = [text.rlike(p) for p in R.XSS_QUICK]
    for check in rest:
        first = first | check
    return first


def xss_likely_context(text: Column) -> Column:
    return (
        F.when(text.contains("<") & text.contains(">"), "HtmlContent")
        .when(text.contains("on") & text.contains("="), "HtmlAttribute")
        .when(text.contains("javascript:"), "UrlParameter")
        .when(contains_any(text, ["function", "var "]), "JavascriptCode")
        .when(text.contains(":") & contains_any(text, ["px", "color"]), "CssStyle")
        .otherwise("Unknown")
    )
