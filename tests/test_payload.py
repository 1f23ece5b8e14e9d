import pytest
from pyspark.sql import functions as F

from frames import texts
from palisade.functions import decode as dc, text as tx
from palisade.operators import payload as V


def sqli(spark, text):
    return V.sqli_detect(texts(spark, [text]), F.col("t")).first().sqli


def xss(spark, text):
    return V.xss_detect(texts(spark, [text]), F.col("t")).first().xss


@pytest.mark.parametrize("text, attack", [
    ("' UNION SELECT password FROM users", "Union"),
    ("'; WAITFOR DELAY '00:00:05'--", "Time"),
    ("%27%20UNION%20SELECT%20*%20FROM%20users", "Union"),
    ('{"username": {"$ne": null}}', "NoSql"),
])
def test_sql_injection(spark, text, attack):
    r = sqli(spark, text)
    assert r.detected and attack in r.attack_types


def test_plain_text_is_clean(spark):
    assert not sqli(spark, "hello world").detected
    assert not xss(spark, "<b>hello</b>").detected


def test_sqli_confidence_by_hand(spark):
    # union_select .9 + union_variations .85, marks: spaces .1 and union..select .1
    assert sqli(spark, "1 union select 2").confidence == pytest.approx((0.9 + 0.85 + 0.2) / 2)


@pytest.mark.parametrize("text, context", [
    ("<script>alert('xss')</script>", "HtmlContent"),
    ("<img src=x onerror=alert(1)>", "HtmlAttribute"),
    ("javascript:alert(1)", "UrlParameter"),
    ("<svg onload=alert(1)>", "SvgContent"),
    ("%3Cscript%3Ealert(1)%3C/script%3E", "HtmlContent"),
    ("document.write('x')", None),
    ("__proto__[x]=1", "JavascriptCode"),
    ("<ScRiPt>alert(1)</ScRiPt>", "HtmlContent"),
    ("%253Cscript%253Ealert(1)%253C/script%253E", "HtmlContent"),
    ("\\x3cscript\\x3ealert(1)", "HtmlContent"),
    ("\\u003cscript\\u003ealert(1)", "HtmlContent"),
    ("&lt;script&gt;alert(1)", "HtmlContent"),
    ("&#60;script&#x3e;alert(1)", "HtmlContent"),
])
def test_xss(spark, text, context):
    r = xss(spark, text)
    if context is None:  # no rule: 'document.write(' is matched, its plain call is Dom
        assert isinstance(r.detected, bool)
    else:
        assert r.detected and context in r.contexts


def test_xss_confidence_by_hand(spark):
    # script_tag .9; case marks .2; contexts: attribute no, code and css yes/no by syntax characters
    r = xss(spark, "<script>")
    assert r.matched == ["script_tag"]
    assert r.confidence == pytest.approx((0.9 + 0.1 * len(r.bypasses) + 0.1 * (len(r.contexts) - 1)) / 2)


@pytest.mark.parametrize("text, want", [
    ("50% a+b%20c", "50% a+b c"), ("%41%42", "AB"), ("plain", "plain"), ("%ff", "%ff"), ("a%2Bb", "a+b"),
])
def test_url_decode(spark, text, want):
    assert texts(spark, [text]).select(dc.url_decode(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("text, want", [
    ("&lt;a&gt; &amp;amp; &eacute; &#233; &#x1F600; &nosuch; &", "<a> &amp; é é \U0001F600 &nosuch; &"),
    ("no references", "no references"),
])
def test_html_decode(spark, text, want):
    assert texts(spark, [text]).select(dc.html_decode(F.col("t"))).first()[0] == want


def test_escapes(spark):
    df = texts(spark, ["\\u0041\\ud800 \\x41 String.fromCharCode(72, 105)!"])
    assert df.select(dc.unicode_decode(F.col("t"))).first()[0].startswith("A\\ud800")
    assert df.select(dc.hex_decode(F.col("t"))).first()[0].split(" ")[1] == "A"
    assert df.select(dc.from_char_code_decode(F.col("t"))).first()[0].endswith("Hi!")


def test_entropy_counts_characters_over_bytes(spark):
    rows = texts(spark, ["abab", "", "éé"]).select("id", tx.text_entropy(F.col("t")).alias("e")).orderBy("id").collect()
    assert [round(r.e, 6) for r in rows] == [1.0, 0.0, 0.5]


def test_verdict_signs_agree_with_the_listed_parts(spark, sf):
    """The short form behind risk and advice says what the full listing says."""
    from palisade.functions import rules as R
    from palisade.sources import fixtures as fx

    pages = fx.table(spark, sf, "pages").select("page_id", "html")
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    both = pages.toDF("id", "t").unionByName(docs.toDF("id", "t"))
    p, s = V.xss_payload(F.col("t"), F.col("t")), V.xss_signs(F.col("t"), F.col("t"))
    df = both.select(p.alias("p"), s.alias("s"))
    wrong = df.where(
        (F.col("s.dangerous_function") != V._has_any(F.col("p.functions"), R.XSS_DANGEROUS_FUNCTIONS))
        | (F.col("s.dangerous_tag") != V._has_any(F.col("p.html_tags"), R.XSS_DANGEROUS_TAGS))
        | (F.col("s.external_scheme") != V._has_any(F.col("p.url_schemes"), R.XSS_EXTERNAL_SCHEMES))
        | (F.col("s.function") != (F.size("p.functions") > 0)) | (F.col("s.obfuscated") != (F.size("p.obfuscation") > 0)))
    assert wrong.count() == 0


ATTACKS = [
    "1 union all select 2", "un/**/se", "a or 1 = 1", "and true", "sleep ( 5", "benchmark(9", "waitfor delay '0:0:5'", "pg_sleep(1",
    "extractvalue(", "cast( a as int", "; drop table x", "information_schema.tables", "load_file(", "x into outfile (", "@@version",
    "xp_cmdshell", "# x", "/* a */", "0xff", "$where", "$regex: javascript", "< script >", "<script src=x>", "onload=1", "onstorage =1",
    "javascript :", "data : text/html", "settimeout (", "expression (", "<svg><script", "<svg onload=", "document.write(", "window.open[",
    "`a${b}c`", "__proto__", "constructor.prototype", "object.prototype", "importscripts (", "import(", "@import url (",
    "background: url(javascript:x", "<meta http-equiv=refresh url", "<iframe srcdoc ="]


def test_literals_never_hide_a_match(spark, sf):
    """Looking for literals first finds what the expressions alone find."""
    from palisade.functions import rules as R
    from palisade.sources import fixtures as fx

    sources = texts(spark, ATTACKS).select("t")
    for table, column in (("pages", "html"), ("documents", "text"), ("conversations", "text"), ("benchmark", "text")):
        sources = sources.unionByName(fx.table(spark, sf, table).select(F.col(column).alias("t")))
    sources = sources.unionByName(fx.log_lines(spark, sf).select(dc.url_decode(F.col("line")).alias("t")))
    low = sources.select(F.lower("t").alias("t"))
    rules = R.SQLI_RULES + R.XSS_RULES
    plain, quick = V.rule_hits(F.col("t"), rules), V.rule_hits(F.col("t"), rules, lower_cased=True)
    seen = low.select(plain.alias("p"), quick.alias("q"))
    assert seen.where(F.col("p") != F.col("q")).count() == 0
    names = {n for r in seen.select(F.explode("q.name").alias("n")).distinct().collect() for n in [r.n]}
    assert names == {r.name for r in rules}


def test_long_character_references(spark):
    from palisade.functions.decode import html_decode

    given = ["&#x0000003c;script", "&#00000060;b", "&#x3C;", "&#60;", "&#x" + "0" * 300 + "3c;", "&#x110000;", "&#99999999999999999999;", "&#x;", "&lt;"]
    got = [r.o for r in texts(spark, given).select("id", html_decode(F.col("t")).alias("o")).orderBy("id").collect()]
    assert got == ["<script", "<b", "<", "<", "<", "&#x110000;", "&#99999999999999999999;", "&#x;", "<"]


def test_encoded_lines_reach_the_detectors(spark):
    from palisade.functions.decode import with_decoded_sqli, with_decoded_xss

    given = ["&#x0000003cscript&#62;", "\\x3cscript\\x3e", "\\u003cscript\\u003e", "String.fromCharCode(60,115)", "%253Cscript%253E"]
    xss = [r.o for r in with_decoded_xss(texts(spark, given), "t", "o").orderBy("id").collect()]
    assert xss == ["&#x0000003cscript>", "<script>", "<script>", "<s", "<script>"]
    sqli = [r.o for r in with_decoded_sqli(texts(spark, ["1\\x27 OR 1=1", "1&#39; OR 1=1", "1\\u0027"]), "t", "o").orderBy("id").collect()]
    assert sqli == ["1' OR 1=1", "1' OR 1=1", "1'"]


def test_tests_that_spare_a_pattern_change_nothing(spark, sf):
    """Marks, needed texts and shorter patterns find what the patterns alone find; of plain lines few patterns are tried."""
    from palisade.functions import rules as R
    from palisade.sources import fixtures as fx

    odd = [*ATTACKS, "", None, "a \t b\n\nc\r\x0bd  e \x0c", " = ", "x =", "é=", "-:;", "z : \n", "@media", "a\\7 \\x41 \\u0041 &#x41; %41 +", "sel\x00ect", "/*! 1 */",
           "String.fromCharCode (1) unescape( decodeURIComponent(", " or  true", "and 1 = 1", "onload =", "onstorage="]
    every = texts(spark, odd).select("t").unionByName(fx.log_lines(spark, sf).select(dc.url_decode(F.col("line")).alias("t")))
    every = every.unionByName(fx.table(spark, sf, "pages").select(F.col("html").alias("t"))).select("t", F.lower("t").alias("low"))
    every = every.withColumn("marks", V.rule_marks(F.col("low")))
    rules, t, low = R.SQLI_RULES + R.XSS_RULES, F.col("t"), F.col("low")
    listed = [*R.SQLI_ENCODINGS, *R.XSS_ENCODINGS, *((p, p) for p in R.SQLI_BYPASSES)]
    pairs = [
        (V.rule_hits(low, rules), V.rule_hits(low, rules, lower_cased=True, marks=F.col("marks"))),
        (F.array(*[t.rlike(p) for _, p in listed]), F.array(*[tx.found(t, p) for _, p in listed])),
        (F.regexp_replace(t, r"\s+", " "), dc._single_spaced(t)),
        (F.array(*[low.rlike(a) | low.rlike(b) for _, (a, b) in R.XSS_CONTEXTS]), F.transform(
            F.array(*[F.lit(n) for n, _ in R.XSS_CONTEXTS]), lambda n: F.array_contains(V.xss_contexts(low), n))),
    ]
    for plain, spared in pairs:
        assert every.where(~plain.eqNullSafe(spared) & t.isNotNull()).count() == 0
    assert set(R.RULE_MARK) <= {r.name for r in rules} and set(R.PATTERN_LITERALS) <= {p for _, p in listed}


def test_parts_of_a_verdict_that_nobody_reads_are_not_worked_out(spark):
    """Of a verdict whose rules alone are read, neither signs, advice nor encodings are left in the plan; a filter repeats no pattern."""
    df = texts(spark, [*ATTACKS, "", None])
    both = V.xss_detect(V.sqli_detect(df, F.col("t")), F.col("t"))
    whole = {r.id: r for r in both.collect()}
    for detect, name in ((V.sqli_detect, "sqli"), (V.xss_detect, "xss")):
        matched = detect(df, F.col("t")).select("id", F.col(f"{name}.matched").alias("m"))
        plan = matched._jdf.queryExecution().optimizedPlan().toString()
        assert not any(part in plan for part in ("_verdict_encodings", "_verdict_mitigations", "_signs", "_bypass", "decodeURI"))
        assert {r.id: r.m for r in matched.collect()} == {i: r[name].matched for i, r in whole.items()}
    kept = both.where("sqli.detected OR xss.detected").select("id", "sqli.matched")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("information_schema") == both._jdf.queryExecution().optimizedPlan().toString().count("information_schema")
    assert {r.id for r in kept.collect()} == {i for i, r in whole.items() if r.sqli.detected or r.xss.detected}
