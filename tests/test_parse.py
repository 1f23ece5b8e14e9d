import datetime as dt

from pyspark.sql import functions as F

from palisade.operators import parse as P

COMMON = '127.0.0.1 - - [10/Oct/2000:13:55:36 +0000] "GET /index.html HTTP/1.0" 200 2326'
ACCESS = '192.168.1.100 - - [10/Oct/2000:13:55:36 +0200] "GET /index.html HTTP/1.1" 200 1234 "http://example.com" "Mozilla/5.0"'
SQLI = '''192.168.1.100 - - [10/Oct/2000:13:55:36 +0000] "GET /search?q=1' UNION SELECT * FROM users-- HTTP/1.1" 200 1234 "-" "sqlmap/1.0"'''
ERROR = ('2023/10/10 13:55:36 [error] 1234#0: *5678 open() "/var/www/html/test.php" failed (2: No such file or directory), '
         'client: 192.168.1.100, server: example.com, request: "GET /test.php HTTP/1.1", host: "example.com"')
CUSTOM = ('10.1.2.3 - - [10/Oct/2000:13:55:36 +0000] "POST /a b c HTTP/1.1" 503 17 "-" "curl/8" '
          'rt=0.250 uct="0.001" uht="0.010" urt="0.240"')


def parse(spark, line, parser):
    lines = spark.createDataFrame([(1, line)], "id long, line string").withColumn(
        "ingest_ts", F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return P.parse_logs(lines, parser=parser).first()


def test_formats(spark):
    rows = [(COMMON, "Apache"), ("nginx: worker started", "Nginx"), ("Oct 10 13:55:36 host sshd[1]: x", "Ssh"),
            ("Oct 10 13:55:36 host cron: x", "Syslog"), ('{"a": 1}', "Json"), ("hello", "Unknown")]
    df = spark.createDataFrame(rows, "line string, want string")
    assert df.where(P.detect_format(F.col("line")) != F.col("want")).count() == 0


def test_apache_common(spark):
    r = parse(spark, COMMON, "Apache")
    assert (r.source, r.source_ip, r.parsed.status_code, r.parsed.size) == ("apache", "127.0.0.1", 200, "2326")
    assert r.ts == dt.datetime(2000, 10, 10, 13, 55, 36)


def test_unmatched_apache(spark):
    r = parse(spark, "no such format", "Apache")
    assert (r.source, r.source_ip, r.severity, r.event_type) == ("apache_unknown", None, "Info", "Normal")
    assert r.ts == dt.datetime(2024, 6, 1)


def test_nginx_access_and_offset(spark):
    r = parse(spark, ACCESS, "Nginx")
    assert (r.source, r.source_ip, r.event_type, r.parsed.path) == ("nginx_access", "192.168.1.100", "Normal", "/index.html")
    assert r.ts == dt.datetime(2000, 10, 10, 11, 55, 36)


def test_nginx_injection(spark):
    r = parse(spark, SQLI, "Nginx")
    assert r.event_type == "SqlInjection"
    assert "suspicious_user_agent:sqlmap" in r.iocs


def test_nginx_error(spark):
    r = parse(spark, ERROR, "Nginx")
    assert (r.source, r.severity, r.source_ip, r.parsed.server) == ("nginx_error", "Critical", "192.168.1.100", "example.com")
    assert r.parsed.request == "GET /test.php HTTP/1.1"


def test_nginx_error_without_tail(spark):
    r = parse(spark, "2023/10/10 13:55:36 [warn] 1234#0: test error message", "Nginx")
    assert (r.source, r.severity, r.parsed.message, r.source_ip) == ("nginx_error", "Warning", "test error message", None)


def test_nginx_custom_comes_first(spark):
    r = parse(spark, CUSTOM, "Nginx")
    assert (r.source, r.severity, r.parsed.response_time, r.parsed.path) == ("nginx_custom", "Critical", "0.250", "/a")


def test_ssh(spark):
    r = parse(spark, "Oct  3 13:55:36 host sshd[9]: Failed password for invalid user bob from 10.0.0.9 port 22 ssh2", "Ssh")
    assert (r.parsed.auth_outcome, r.parsed.user, r.source_ip) == ("failed", "bob", "10.0.0.9")
    assert r.ts == dt.datetime(2024, 10, 3, 13, 55, 36)


def test_filters_do_not_repeat_the_parser(spark, sf):
    """A filter on a parsed column must not copy the parser into itself."""
    from palisade.sources import fixtures as fx

    plan = fx.events(spark, sf).where("severity = 'Critical' AND event_type <> 'Normal'")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_replace(translate(") <= 3
