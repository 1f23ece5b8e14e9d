"""Registered queries: text functions and payload detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions import decode as dc, dimensions as D, rules as R, text as tx
from palisade.operators import payload as V
from palisade.plans import oracle as O
from palisade.plans.oracle import ev, matching, q, qlist
from palisade.plans.registry import big, joined, query, r6
from palisade.sources import fixtures as fx

J = O.joined
TEXT = "raw_message || ' ' || parsed_json"
DOCS = "SELECT doc_id AS id, text FROM documents"


def _norm_sqli(x):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\\s+', ' ', 'g'), '--.*$', '', 'g'), '/\\*.*?\\*/', ' ', 'g'))"


def _norm_xss(x):
    inner = f"regexp_replace(regexp_replace(lower({x}), '\\s+', ' ', 'g'), '<!--.*?-->', '', 'g')"
    return f"replace(replace(replace({inner}, '&#39;', ''''), '&#34;', '\"'), '&quot;', '\"')"


def _all(text, pattern, group=1):
    return f"regexp_extract_all({text}, {q(pattern)}, {group})"


def _seen(lst):
    """Distinct values in first-seen order."""
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


def _low(lst, prefix=""):
    return f"list_transform({lst}, lambda x: '{prefix}' || lower(x))"


def _advice(types, table):
    m = "MAP {" + ", ".join(f"{q(k)}: {qlist(v)}" for k, v in table.items()) + "}"
    return f"flatten(list_transform({types}, lambda t: coalesce({m}[t], [])))"


def _if(cond, texts):
    return f"CASE WHEN {cond} THEN {qlist(texts)} ELSE [] END"


def _cat(*lists):
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


def _risk(medium):
    return f"""CASE WHEN conf >= 0.9 THEN 'Critical' WHEN conf >= 0.7 THEN 'High' WHEN factors >= 4 THEN 'Critical' WHEN factors >= 2 THEN 'High'
      WHEN conf >= {medium} THEN 'Medium' ELSE 'Low' END"""


_BYPASS_N = " + ".join(f"CAST(regexp_matches(norm, {q(p)}) AS INTEGER)" for p in R.SQLI_BYPASSES)
_SQLI_RULES = ", ".join(
    f"CASE WHEN regexp_matches(norm, {q(r.regex)}) THEN {{'n': {q(r.name)}, 'c': {r.confidence}::DOUBLE, 't': {q(r.attack_type)}}} END" for r in R.SQLI_RULES)
SQLI = f"""
sq0 AS MATERIALIZED (SELECT id, txt, decoded, {_norm_sqli('decoded')} AS norm FROM (SELECT id, {TEXT} AS txt, url_decode({TEXT}) AS decoded FROM ev)),
sq1 AS MATERIALIZED (SELECT *, list_filter([{_SQLI_RULES}], lambda m: m IS NOT NULL) AS hits, least(0.1 * ({_BYPASS_N}), 0.3)::DOUBLE AS bypass,
   {matching('txt', R.SQLI_ENCODINGS)} AS enc, {_low(_all('decoded', R.SQL_WORDS))} AS words FROM sq0),
sq2 AS MATERIALIZED (SELECT *, CASE WHEN len(hits) > 0 THEN least((list_sum(list_transform(hits, lambda h: h.c)) + bypass) / len(hits), 1.0) ELSE 0.0 END AS conf,
   {_seen('list_transform(hits, lambda h: h.t)')} AS types FROM sq1),
sq3 AS MATERIALIZED (SELECT *, CAST(len(types) > 2 AS INTEGER) + 2 * CAST(list_has_any(words, {qlist(R.SQL_DANGEROUS_WORDS)}) AS INTEGER)
   + CAST(len(enc) > 1 AS INTEGER) + CAST(list_contains(types, 'Time') AS INTEGER) AS factors FROM sq2)"""

_XSS_RULES = ", ".join(
    f"CASE WHEN regexp_matches(norm, {q(r.regex)}) THEN {{'n': {q(r.name)}, 'c': {r.confidence}::DOUBLE, 't': {q(r.attack_type)}, 's': {q(r.scope)}}} END" for r in R.XSS_RULES)
_XSS_CTX = ", ".join(
    f"CASE WHEN regexp_matches(norm, {q(a)}) OR regexp_matches(norm, {q(b)}) THEN {q(n)} END" for n, (a, b) in R.XSS_CONTEXTS)
_OBF = """list_filter([CASE WHEN contains(decoded, 'String.fromCharCode') THEN 'fromcharcode' END, CASE WHEN contains(decoded, 'eval(') THEN 'eval' END,
   CASE WHEN regexp_matches(txt, '\\\\x[0-9a-fA-F]{2}') THEN 'hex_encoding' END, CASE WHEN regexp_matches(txt, '&#x?[0-9]+;') THEN 'html_entities' END,
   CASE WHEN contains(decoded, '/*') AND contains(decoded, '*/') THEN 'comment_hiding' END], lambda m: m IS NOT NULL)"""
XSS_PARTS = f"""{matching('txt', R.XSS_ENCODINGS)} AS enc, {_seen(_low(_all('decoded', R.HTML_TAG)))} AS tags,
   {_seen(_low(_all('decoded', R.JS_EVENT), 'on'))} AS handlers, {_seen(_low(_all('decoded', R.JS_FUNCTION)))} AS funcs,
   {_seen(_low(_all('decoded', R.CSS_PROPERTY)))} AS css,
   {_cat(_seen(_low(_all('decoded', R.URL_SCHEME))), _if("contains(lower(decoded), 'javascript:')", ['javascript']), _if("contains(lower(decoded), 'data:')", ['data']))} AS schemes,
   {_seen(_all('decoded', R.XSS_SPECIAL_CHARS, 0))} AS specials, {_OBF} AS obf"""
XSS = f"""
xs0 AS MATERIALIZED (SELECT id, txt, decoded, {_norm_xss('decoded')} AS norm FROM (SELECT id, {TEXT} AS txt, url_decode(url_decode(url_decode({TEXT}))) AS decoded FROM ev)),
xs1 AS MATERIALIZED (SELECT *, list_filter([{_XSS_RULES}], lambda m: m IS NOT NULL) AS hits, {matching('norm', R.XSS_BYPASSES)} AS byp,
   list_filter([{_XSS_CTX}], lambda m: m IS NOT NULL) AS signs, {XSS_PARTS} FROM xs0),
xs2 AS MATERIALIZED (SELECT *, {_seen('list_transform(hits, lambda h: h.t)')} AS types, {_seen('list_transform(hits, lambda h: h.s)')} AS rctx FROM xs1),
xs3 AS MATERIALIZED (SELECT *, list_filter(signs, lambda s: NOT list_contains(rctx, s)) AS fresh FROM xs2),
xs4 AS MATERIALIZED (SELECT *, list_concat(rctx, fresh) AS ctx,
   CASE WHEN len(hits) > 0 THEN least((list_sum(list_transform(hits, lambda h: h.c)) + len(byp) * 0.1::DOUBLE + len(fresh) * 0.1::DOUBLE) / (len(hits) + 1), 1.0) ELSE 0.0 END AS conf FROM xs3),
xs5 AS MATERIALIZED (SELECT *, 2 * CAST(list_has_any(funcs, {qlist(R.XSS_DANGEROUS_FUNCTIONS)}) AS INTEGER) + CAST(len(enc) > 1 AS INTEGER)
   + CAST(list_has_any(types, ['Dom', 'PrototypePollution']) AS INTEGER) + CAST(list_has_any(tags, {qlist(R.XSS_DANGEROUS_TAGS)}) AS INTEGER)
   + CAST(list_has_any(schemes, {qlist(R.XSS_EXTERNAL_SCHEMES)}) AS INTEGER) AS factors FROM xs4)"""


# --- scalar functions -------------------------------------------------------

@query("decode_sqli", ev("SELECT id, url_decode(raw_message) AS decoded FROM ev"))
def decode_sqli(spark, sf):
    return dc.with_decoded_sqli(fx.events(spark, sf), "raw_message", "decoded").select("id", "decoded")


@query("decode_xss", ev("SELECT id, url_decode(url_decode(url_decode(raw_message))) AS decoded FROM ev"))
def decode_xss(spark, sf):
    return dc.with_decoded_xss(fx.events(spark, sf), "raw_message", "decoded").select("id", "decoded")


@query("normalize_sqli", f"SELECT id, sha256({_norm_sqli('text')}) AS normalized FROM ({DOCS})")
def normalize_sqli(spark, sf):
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.sha2(dc.normalize_sqli(F.col("text")), 256).alias("normalized"))


@query("normalize_xss", f"SELECT page_id AS id, sha256({_norm_xss('html')}) AS normalized, sha256(trim(regexp_replace(regexp_replace(lower(html), '\\s+', ' ', 'g'), '<!--.*?-->', '', 'g'))) AS payload FROM pages")
def normalize_xss(spark, sf):
    return fx.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.sha2(dc.normalize_xss(F.col("html")), 256).alias("normalized"),
        F.sha2(dc.normalize_xss_payload(F.col("html")), 256).alias("payload"))


def entropy_sql(table, key, text):
    """Entropy from one row per (key, character)."""
    return f"""SELECT {key}, -sum(n / size * log2(n / size)) AS entropy FROM (
      SELECT {key}, ch, count(*)::DOUBLE AS n, any_value(size) AS size FROM (
        SELECT {key}, unnest(string_split({text}, '')) AS ch, strlen({text})::DOUBLE AS size FROM {table} WHERE strlen({text}) > 0)
      GROUP BY 1, 2) GROUP BY 1"""


@query("text_entropy", f"WITH e AS ({entropy_sql('documents', 'doc_id', 'text')}) SELECT d.doc_id AS id, round(coalesce(e.entropy, 0.0), 6) AS entropy FROM documents d LEFT JOIN e USING (doc_id)")
def text_entropy(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), r6(tx.text_entropy(F.col("text"))).alias("entropy"))


@query("payload_hash", "SELECT doc_id AS id, sha256(text) AS hash FROM documents")
def payload_hash(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), tx.payload_hash(F.col("text")).alias("hash"))


@query("sql_keywords", f"SELECT doc_id AS id, regexp_matches(text, {q(R.SQL_BASIC_WORDS)}) AS has_keywords, {J(_low(_all('text', R.SQL_BASIC_WORDS)))} AS keywords FROM documents")
def sql_keywords(spark, sf):
    t = F.col("text")
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), tx.has_sql_keywords(t).alias("has_keywords"), joined(tx.sql_keywords(t)).alias("keywords"))


@query("html_extract", f"SELECT page_id AS id, {J(_low(_all('html', R.HTML_TAG)))} AS tags, {J(_low(_all('html', R.JS_EVENT), 'on'))} AS handlers FROM pages")
def html_extract(spark, sf):
    h = F.col("html")
    return fx.table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), joined(tx.html_tags(h)).alias("tags"), joined(tx.html_event_handlers(h)).alias("handlers"))


# --- SQL injection ----------------------------------------------------------

def _sqli(spark, sf, payload=False):
    events = fx.events(spark, sf)
    return V.sqli_detect(events.select("id", V.detection_text(events).alias("t")), F.col("t"), payload=payload)


@query("sqli_detect", ev(f"SELECT id, conf >= 0.3 AS detected, round(conf, 6) AS confidence, {J('types')} AS attack_types, {J('list_transform(hits, lambda h: h.n)')} AS matched FROM sq3", SQLI))
def sqli_detect(spark, sf):
    s = F.col("sqli")
    return _sqli(spark, sf).select(
        "id", s.detected.alias("detected"), r6(s.confidence).alias("confidence"),
        joined(s.attack_types).alias("attack_types"), joined(s.matched).alias("matched"))


@query("sqli_bypass", f"SELECT id, round(least(0.1 * ({_BYPASS_N}), 0.3)::DOUBLE, 6) AS bypass FROM (SELECT id, {_norm_sqli('text')} AS norm FROM ({DOCS}))")
def sqli_bypass(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), dc.normalize_sqli(F.col("text")).alias("norm"))
    return docs.select("id", r6(V.sqli_bypass(F.col("norm"))).alias("bypass"))


@query("sqli_payload", ev(f"""SELECT id, {J('enc')} AS encodings, {J('words')} AS keywords, {J(_seen(_all('decoded', R.SQL_SPECIAL_CHARS, 0)))} AS special_chars,
   {J("list_filter([CASE WHEN contains(decoded, '--') THEN 'line_comment' END, CASE WHEN contains(decoded, '/*') AND contains(decoded, '*/') THEN 'block_comment' END, CASE WHEN contains(decoded, '#') THEN 'hash_comment' END], lambda m: m IS NOT NULL)")} AS comments,
   {J("list_filter([CASE WHEN contains(decoded, '''') THEN 'single_quote' END, CASE WHEN contains(decoded, chr(34)) THEN 'double_quote' END, CASE WHEN contains(decoded, '`') THEN 'backtick' END], lambda m: m IS NOT NULL)")} AS quotes FROM sq3""", SQLI))
def sqli_payload(spark, sf):
    p = F.col("sqli_payload")
    return _sqli(spark, sf, payload=True).select(
        "id", *[joined(p[n]).alias(n) for n in ("encodings", "keywords", "special_chars", "comments", "quotes")])


@query("sqli_risk", ev(f"SELECT id, {_risk(0.5)} AS risk_level FROM sq3", SQLI))
def sqli_risk(spark, sf):
    return _sqli(spark, sf).select("id", F.col("sqli.risk_level").alias("risk_level"))


@query("sqli_mitigations", ev(f"SELECT id, {J(_cat(qlist(D.SQLI_GENERAL_ADVICE), _advice('types', D.SQLI_TYPE_ADVICE), _if('len(enc) > 0', D.SQLI_ENCODING_ADVICE)))} AS mitigations FROM sq3", SQLI))
def sqli_mitigations(spark, sf):
    return _sqli(spark, sf).select("id", joined("sqli.mitigations").alias("mitigations"))


# --- cross-site scripting ---------------------------------------------------

def _xss(spark, sf, payload=False):
    events = fx.events(spark, sf)
    return V.xss_detect(events.select("id", V.detection_text(events).alias("t")), F.col("t"), payload=payload)


@query("xss_detect", ev(f"SELECT id, conf >= 0.25 AS detected, round(conf, 6) AS confidence, {J('types')} AS attack_types, {J('list_transform(hits, lambda h: h.n)')} AS matched FROM xs5", XSS))
def xss_detect(spark, sf):
    x = F.col("xss")
    return _xss(spark, sf).select(
        "id", x.detected.alias("detected"), r6(x.confidence).alias("confidence"),
        joined(x.attack_types).alias("attack_types"), joined(x.matched).alias("matched"))


@query("xss_bypass", f"SELECT page_id AS id, {J(matching('norm', R.XSS_BYPASSES))} AS bypasses FROM (SELECT page_id, {_norm_xss('html')} AS norm FROM pages)")
def xss_bypass(spark, sf):
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("id"), dc.normalize_xss(F.col("html")).alias("norm"))
    return pages.select("id", joined(V.xss_bypass(F.col("norm"))).alias("bypasses"))


@query("xss_contexts", ev(f"SELECT id, {J('signs')} AS signs, {J('ctx')} AS contexts, CAST(len(fresh) AS BIGINT) AS added FROM xs5", XSS))
def xss_contexts(spark, sf):
    events = fx.events(spark, sf)
    decoded = dc.with_decoded_xss(events.select("id", V.detection_text(events).alias("t")), "t", "d")
    seen = V.xss_detect(decoded, F.col("t")).withColumn("norm", dc.normalize_xss(F.col("d")))
    ctx = F.col("xss.contexts")
    rule_ctx = V._distinct(V.rule_hits(F.col("norm"), R.XSS_RULES), "scope")
    return seen.select(
        "id", joined(V.xss_contexts(F.col("norm"))).alias("signs"), joined(ctx).alias("contexts"),
        big(F.size(ctx) - F.size(rule_ctx)).alias("added"))


_PAYLOAD_OUT = f"{J('enc')} AS encodings, {J('tags')} AS html_tags, {J('handlers')} AS events, {J('funcs')} AS functions, {J('css')} AS css_properties, {J('schemes')} AS url_schemes, {J('specials')} AS special_chars, {J('obf')} AS obfuscation"
_PAYLOAD_FIELDS = ("encodings", "html_tags", "events", "functions", "css_properties", "url_schemes", "special_chars", "obfuscation")


@query("xss_payload", ev(f"SELECT id, {_PAYLOAD_OUT} FROM xs5", XSS))
def xss_payload(spark, sf):
    p = F.col("xss_payload")
    return _xss(spark, sf, payload=True).select("id", *[joined(p[n]).alias(n) for n in _PAYLOAD_FIELDS])


@query("xss_payload_pages", f"SELECT id, {_PAYLOAD_OUT} FROM (SELECT *, {XSS_PARTS} FROM (SELECT page_id AS id, html AS txt, html AS decoded FROM pages))")
def xss_payload_pages(spark, sf):
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").alias("id"), V.xss_payload(F.col("html"), F.col("html")).alias("p"))
    return pages.select("id", *[joined(F.col("p")[n]).alias(n) for n in _PAYLOAD_FIELDS])


@query("xss_risk", ev(f"SELECT id, {_risk(0.4)} AS risk_level FROM xs5", XSS))
def xss_risk(spark, sf):
    return _xss(spark, sf).select("id", F.col("xss.risk_level").alias("risk_level"))


_XSS_ADVICE = _cat(
    qlist(D.XSS_GENERAL_ADVICE), _advice("types", D.XSS_TYPE_ADVICE), _advice("ctx", D.XSS_CONTEXT_ADVICE),
    _if("len(enc) > 0", D.XSS_ENCODING_ADVICE), _if("len(funcs) > 0", D.XSS_FUNCTION_ADVICE), _if("len(obf) > 0", D.XSS_OBFUSCATION_ADVICE))


@query("xss_mitigations", ev(f"SELECT id, {J(f'list_sort(list_distinct({_XSS_ADVICE}))')} AS mitigations FROM xs5", XSS))
def xss_mitigations(spark, sf):
    return _xss(spark, sf).select("id", joined("xss.mitigations").alias("mitigations"))


_KNOWN = "CASE " + " ".join(f"WHEN regexp_matches(t, {q(p)}) THEN {q(n)}" for n, p in R.XSS_KNOWN_PAYLOADS) + " END"
_QUICK = " OR ".join(f"regexp_matches(t, {q(p)})" for p in R.XSS_QUICK)
_DECODED_LINES = "(SELECT event_id AS id, url_decode(line) AS t FROM (" + fx.LOG_LINES + ") UNION ALL SELECT page_id, html FROM pages)"


def _texts(spark, sf):
    lines = fx.log_lines(spark, sf).select("id", dc.url_decode(F.col("line")).alias("t"))
    return lines.unionByName(fx.table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("t")))


@query("xss_known_bypass", f"SELECT id, {_KNOWN} AS known FROM {_DECODED_LINES}")
def xss_known_bypass(spark, sf):
    return _texts(spark, sf).select("id", V.xss_known_bypass(F.col("t")).alias("known"))


@query("xss_quick", f"SELECT id, ({_QUICK}) AS suspicious FROM {_DECODED_LINES}")
def xss_quick(spark, sf):
    return _texts(spark, sf).select("id", V.xss_quick(F.col("t")).alias("suspicious"))


@query("xss_likely_context", f"""SELECT id, CASE WHEN contains(t, '<') AND contains(t, '>') THEN 'HtmlContent' WHEN contains(t, 'on') AND contains(t, '=') THEN 'HtmlAttribute'
   WHEN contains(t, 'javascript:') THEN 'UrlParameter' WHEN contains(t, 'function') OR contains(t, 'var ') THEN 'JavascriptCode'
   WHEN contains(t, ':') AND (contains(t, 'px') OR contains(t, 'color')) THEN 'CssStyle' ELSE 'Unknown' END AS context FROM {_DECODED_LINES}""")
def xss_likely_context(spark, sf):
    return _texts(spark, sf).select("id", V.xss_likely_context(F.col("t")).alias("context"))
