"""Rule catalogues: regular expressions, word lists and score constants.

Everything in this file is a fixed value: detections only agree with the
specified behaviour when these lists are exactly these, in this order.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    confidence: float
    attack_type: str
    scope: str | None
    regex: str


# SQL injection rules.
SQLI_RULES = [
    Rule("union_select", 0.9, "Union", None, r"(?i)\bunion\s+(?:all\s+)?select\b"),
    Rule("union_variations", 0.85, "Union", None,
         r"(?i)\b(un|uni|unio|union)(\s|\/\*.*?\*\/|\+|%20)+(al|all|se|sel|sele|selec|select)\b"),
    Rule("boolean_logic", 0.8, "Boolean", None, r"(?i)(and|or)\s+(\d+\s*=\s*\d+)"),
    Rule("tautology", 0.85, "Boolean", None, r"(?i)(or|and)\s+(1\s*=\s*1|true|false)"),
    Rule("time_delay_mysql", 0.9, "Time", None, r"(?i)\b(sleep|benchmark)\s*\(\s*\d+"),
    Rule("time_delay_mssql", 0.9, "Time", None, r"(?i)\bwaitfor\s+delay\s+\'\d+:\d+:\d+\'"),
    Rule("time_delay_postgresql", 0.9, "Time", None, r"(?i)\bpg_sleep\s*\(\s*\d+"),
    Rule("error_functions", 0.8, "Error", None,
         r"(?i)\b(extractvalue|updatexml|exp|floor|rand|count)\s*\("),
    Rule("cast_conversion", 0.7, "Error", None, r"(?i)\b(cast|convert)\s*\(\s*.*\s+as\s+"),
    Rule("stacked_queries", 0.9, "Stored", None,
         r";\s*(insert|update|delete|drop|create|alter|exec|execute)\s+"),
    Rule("information_schema", 0.85, "Union", None,
         r"(?i)\binformation_schema\.(tables|columns|schemata)"),
    Rule("mysql_functions", 0.8, "Union", None,
         r"(?i)\b(version|user|database|schema|concat|group_concat|load_file|into\s+outfile)\s*\("),
    Rule("mssql_functions", 0.85, "Union", None,
         r"(?i)\b(@@version|db_name|user_name|system_user|xp_cmdshell|sp_executesql)\s*"),
    Rule("sql_comments", 0.6, "Boolean", None, r"(?:--|#|/\*.*?\*/)"),
    Rule("hex_encoding", 0.7, "Blind", None, r"(?i)0x[0-9a-f]+"),
    Rule("nosql_operators", 0.8, "NoSql", None,
         r"\$(?:ne|gt|lt|gte|lte|in|nin|exists|regex|where|size)"),
    Rule("mongodb_injection", 0.9, "NoSql", None, r"(?i)\$(?:where|regex).*javascript"),
]

# Encodings looked for in the raw text, SQL detector.
SQLI_ENCODINGS = [
    ("url_encoding", r"%[0-9a-fA-F]{2}"),
    ("html_entities", r"&#x?[0-9a-fA-F]+;"),
    ("hex_escape", r"\\x[0-9a-fA-F]{2}"),
    ("unicode_escape", r"\\u[0-9a-fA-F]{4}"),
    ("space_plus", r"\+"),
]

# Filter-evasion marks, SQL detector; 0.1 each, at most 0.3.
SQLI_BYPASSES = [
    r"(?i)/\*!?\d*\s*\*/",
    r"(?i)\s+",
    r"(?i)union(?:\s|/\*.*?\*/)+select",
    r"(?i)sel\x00ect",
    r"(?i)\+",
]

# SQL words.
SQL_WORDS = (
    r"(?i)\b(select|union|insert|update|delete|drop|create|alter|exec|execute|declare|cast|convert"
    r"|substr|substring|concat|group_concat|version|user|database|schema|table|column|from|where"
    r"|order|group|having|into|values|set|join|inner|left|right|outer|on|as|like|in|exists|between"
    r"|is|null|not|and|or|xor|true|false|case|when|then|else|end)\b"
)
SQL_BASIC_WORDS = r"(?i)\b(select|union|insert|update|delete|drop|create|alter|exec|execute)\b"
SQL_DANGEROUS_WORDS = ["drop", "delete", "exec", "execute", "xp_cmdshell"]
SQL_SPECIAL_CHARS = r"""['"`;()\[\]{}*+\-=<>!@#$%^&|\\/]"""

# XSS rules.
XSS_RULES = [
    Rule("script_tag", 0.9, "Reflected", "HtmlContent", r"(?i)<\s*script[^>]*>"),
    Rule("script_tag_with_src", 0.95, "Reflected", "HtmlContent", r"(?i)<\s*script[^>]*src\s*="),
    Rule("javascript_events", 0.85, "Reflected", "HtmlAttribute",
         r"(?i)\bon(load|error|click|focus|blur|change|submit|mouseover|mouseout|keydown|keyup|resize)\s*="),
    Rule("advanced_events", 0.8, "Dom", "HtmlAttribute",
         r"(?i)\bon(animationend|animationstart|transitionend|beforeunload|hashchange|popstate|storage)\s*="),
    Rule("javascript_scheme", 0.9, "Reflected", "UrlParameter", r"(?i)javascript\s*:"),
    Rule("data_scheme_html", 0.85, "Reflected", "UrlParameter", r"(?i)data\s*:\s*text/html"),
    Rule("javascript_eval", 0.8, "Dom", "JavascriptCode",
         r"(?i)\b(eval|function|settimeout|setinterval)\s*\("),
    Rule("css_expression", 0.9, "Reflected", "CssStyle", r"(?i)expression\s*\("),
    Rule("svg_script", 0.9, "Reflected", "SvgContent", r"(?i)<\s*svg[^>]*>.*?<\s*script"),
    Rule("svg_onload", 0.85, "Reflected", "SvgContent", r"(?i)<\s*svg[^>]*onload\s*="),
    Rule("dom_manipulation", 0.8, "Dom", "JavascriptCode",
         r"(?i)\b(document\.(write|writeln|createElement|innerHTML|outerHTML)|window\.(open|location|name))\s*[\(\[]"),
    Rule("template_literals", 0.7, "Dom", "JavascriptString", r"`[^`]*\$\{[^}]+\}[^`]*`"),
    Rule("prototype_pollution", 0.85, "PrototypePollution", "JavascriptCode",
         r"(?i)(__proto__|constructor\.prototype|Object\.prototype)"),
    Rule("dynamic_import", 0.8, "Dom", "JavascriptCode", r"(?i)\b(import|importScripts)\s*\("),
    Rule("css_import", 0.7, "Reflected", "CssStyle", r"(?i)@import\s+url\s*\("),
    Rule("css_background_image", 0.85, "Reflected", "CssStyle", r"(?i)background.*url.*javascript:"),
    Rule("meta_refresh", 0.8, "Reflected", "HtmlContent", r"(?i)<\s*meta[^>]*refresh[^>]*url"),
    Rule("iframe_srcdoc", 0.85, "Reflected", "HtmlContent", r"(?i)<\s*iframe[^>]*srcdoc\s*="),
]

# Encodings looked for in the raw text, XSS detector.
XSS_ENCODINGS = [
    ("url_encoding", r"%[0-9a-fA-F]{2}"),
    ("html_entities", r"&#x?[0-9a-fA-F]+;"),
    ("hex_escape", r"\\x[0-9a-fA-F]{2}"),
    ("unicode_escape", r"\\u[0-9a-fA-F]{4}"),
    ("octal_escape", r"\\[0-7]{1,3}"),
    ("fromcharcode", r"String\.fromCharCode\s*\("),
    ("unescape", r"unescape\s*\("),
    ("decode_functions", r"decodeURI(?:Component)?\s*\("),
]

# Page contexts, two patterns each.
XSS_CONTEXTS = [
    ("HtmlContent", [r"(?i)<\s*[a-z]+[^>]*>", r"(?i)<!--.*?-->"]),
    ("HtmlAttribute", [r"(?i)\w+\s*=", r"(?i)style\s*="]),
    ("JavascriptCode", [r"(?i)\b(var|let|const|function|class|if|for|while|try|catch)\b", r"[{};()]"]),
    ("CssStyle", [r"(?i)[a-z-]+\s*:\s*[^;]+;?", r"(?i)@(import|media|keyframes)"]),
]

# Filter-evasion marks, XSS detector.
XSS_BYPASSES = [
    ("whitespace_variation", r"(?i)<\s+script"),
    ("whitespace_variation", r"(?i)<script\s*/\s*>"),
    ("whitespace_variation", r"(?i)<script\s+[^>]*>"),
    ("html_comment_bypass", r"(?i)<script<!--"),
    ("html_comment_bypass", r"(?i)<!--.*?script"),
    ("encoding_bypass", r"(?i)%3[cC]script"),
    ("encoding_bypass", r"(?i)&lt;script"),
    ("case_variation", r"(?i)sCrIpT"),
    ("case_variation", r"(?i)[sS][cC][rR][iI][pP][tT]"),
    ("null_byte_injection", r"<script\x00"),
    ("null_byte_injection", r"<script\r\n"),
    ("event_handler_bypass", r"(?i)on\w+.*alert"),
    ("event_handler_bypass", r"(?i)javascript\s*:\s*/\*.*?\*/"),
]

# Payloads with a name of their own.
XSS_KNOWN_PAYLOADS = [
    ("svg_onload_bypass", r"(?i)<svg/onload=alert\(1\)>"),
    ("img_onerror_bypass", r"(?i)<img src=x onerror=alert\(1\)>"),
    ("javascript_scheme_bypass", r"(?i)javascript:alert\(1\)"),
    ("basic_script_injection", r"(?i)<script>alert\(1\)</script>"),
    ("attribute_escape_bypass", r"(?i)'><script>alert\(1\)</script>"),
    ("script_context_escape", r"(?i)</script><script>alert\(1\)</script>"),
    ("event_handler_bypass", r"(?i)onmouseover=alert\(1\)"),
    ("base64_eval_bypass", r"(?i)eval.*atob"),
]

# Quick check.
XSS_QUICK = [
    r"(?i)<script[^>]*>",
    r"(?i)javascript\s*:",
    r"(?i)\bon\w+\s*=",
    r"(?i)<\s*svg[^>]*onload",
]

# Payload parts.
HTML_TAG = r"(?i)<\s*([a-z]+)"
JS_EVENT = r"(?i)\bon([a-z]+)\s*="
JS_FUNCTION = (
    r"(?i)\b(alert|confirm|prompt|eval|function|settimeout|setinterval|document\.write"
    r"|console\.log|window\.open)\s*\("
)
CSS_PROPERTY = r"(?i)\b([a-z-]+)\s*:\s*[^;]+"
URL_SCHEME = r"(?i)\b([a-z]+)://"
XSS_SPECIAL_CHARS = r"""[<>"'&;(){}\[\]=+*/\\|%#`~^$!?]"""
XSS_DANGEROUS_FUNCTIONS = ["eval", "function", "settimeout", "document.write"]
XSS_DANGEROUS_TAGS = ["script", "iframe", "object", "embed"]
XSS_EXTERNAL_SCHEMES = ["http", "https", "ftp"]

# Brute-force rules.
BRUTE_FORCE_RULES = [
    Rule("web_auth_failed", 0.8, "Authentication", "Web",
         r"(?i)(authentication failed|invalid (password|credentials|login)|access denied|unauthorized|401|403)"),
    Rule("ssh_auth_failed", 0.9, "Authentication", "Ssh",
         r"(?i)(ssh.*failed|sshd.*authentication failure|invalid user|refused connect)"),
    Rule("ftp_auth_failed", 0.85, "Authentication", "Ftp",
         r"(?i)(ftp.*login failed|ftp.*authentication failed|530 login incorrect)"),
    Rule("database_auth_failed", 0.9, "Database", "Database",
         r"(?i)(mysql.*access denied|postgresql.*authentication failed|oracle.*invalid username|mssql.*login failed)"),
    Rule("api_auth_failed", 0.8, "Api", "Api",
         r"(?i)(api.*unauthorized|invalid api key|bearer token|oauth.*failed)"),
    Rule("directory_enumeration", 0.7, "Directory", "Web",
         r"(?i)(404.*not found|403.*forbidden).*(admin|backup|test|dev|staging|config)"),
    Rule("parameter_fuzzing", 0.6, "Parameter", "Web",
         r"(?i)(GET|POST).*[\?&](id|user|admin|test|debug)=\d+"),
    Rule("session_brute_force", 0.7, "Session", "Web",
         r"(?i)(session.*invalid|csrf.*failed|sessionid.*not found)"),
]

# Words that mean success, tried when the status code says nothing.
SUCCESS_PATTERNS = [
    r"(?i)\b(success|successful|accepted|authenticated|authorized|logged in|welcome)\b",
    r"(?i)\b(granted|allowed|permitted|approved|valid|correct)\b",
    r"\b(200|201|202|204)\b",
]

# Common account names.
COMMON_USERNAMES = ["admin", "administrator", "root", "user", "test", "guest"]

# Substrings that classify a line, first group wins.
EVENT_TYPE_WORDS = [
    ("SqlInjection", [
        "union select", "drop table", "insert into", "delete from", "update set", "create table",
        "alter table", "exec(", "0x", "char(", "ascii(", "substring(", "waitfor delay"]),
    ("XssAttempt", [
        "<script", "javascript:", "onerror=", "onload=", "onclick=", "document.cookie",
        "document.write", "eval(", "alert("]),
    ("BruteForce", [
        "failed login", "authentication failed", "invalid password", "login failed",
        "access denied", "unauthorized access"]),
    ("SuspiciousActivity", [
        "../", "..\\", "/etc/passwd", "/etc/shadow", "cmd.exe", "powershell", "whoami", "netstat",
        "ps aux", "ls -la"]),
]

# Words in an Apache request path.
APACHE_SQL_WORDS = ["union", "select", "drop", "insert"]
APACHE_XSS_WORDS = ["<script", "javascript:", "onerror", "onload"]
APACHE_IOCS = [
    "union select", "drop table", "../../../", "cmd.exe", "powershell", "/etc/passwd",
    "base64_decode", "eval(", "<script>", "javascript:", "document.cookie",
]

# Attack substrings in nginx requests, by family.
NGINX_IOCS = [
    # SQL injection
    "union select", "drop table", "insert into", "delete from", "update set", "exec(", "exec sp_",
    "xp_cmdshell", "sp_executesql", "0x", "char(", "ascii(", "substring(", "waitfor delay",
    "benchmark(",
    # cross-site scripting
    "<script", "javascript:", "onerror=", "onload=", "onclick=", "onmouseover=",
    "document.cookie", "document.write", "eval(", "alert(", "confirm(", "prompt(",
    "fromcharcode", "innerhtml", "outerhtml",
    # path traversal
    "../", "..\\", "/etc/passwd", "/etc/shadow", "/etc/hosts", "c:\\windows", "boot.ini",
    "win.ini", "system32", "/proc/version", "/proc/cpuinfo",
    # command injection
    "cmd.exe", "powershell", "bash", "/bin/sh", "whoami", "netstat", "ps aux", "ls -la",
    "cat /etc", "type c:\\", "dir c:\\",
    # file inclusion
    "php://filter", "php://input", "data://", "file://", "ftp://", "expect://", "zip://",
    "compress.zlib://",
    # XML entities
    "<!entity", "<!doctype", "system \"", "public \"", "file:///",
    # LDAP injection
    "ldap://", "ldaps://", "(&", "(|", "*)(", "*)(",
    # NoSQL injection
    "[$ne]", "[$regex]", "[$where]", "[$gt]", "[$lt]", "[$exists]",
    # template injection
    "{{", "}}", "${", "<%", "%>", "{%", "%}",
]
NGINX_TOOL_AGENTS = [
    "sqlmap", "nmap", "nikto", "burp", "zap", "w3af", "havij", "pangolin", "darkjumper",
    "sql power injector", "bbqsql", "python-requests", "curl", "wget", "libwww-perl",
    "lwp-request",
]
NGINX_RISKY_METHODS = ["TRACE", "TRACK", "DEBUG", "OPTIONS", "CONNECT"]
NGINX_ERROR_IOCS = [
    "access forbidden by rule", "modsecurity", "blocked by security", "rate limiting",
    "too many requests", "client denied by server", "ssl handshake failed",
    "certificate verify failed", "upstream timed out", "no live upstreams",
    "connection refused", "file not found", "permission denied", "directory index forbidden",
    "buffer overflow", "stack overflow", "heap overflow", "format string", "use after free",
    "double free", "null pointer", "segmentation fault",
]

# Line formats.
APACHE_COMMON = r'(\S+) \S+ \S+ \[([\w:/]+\s[+\-]\d{4})\] "(\S+) (\S+) (\S+)" (\d{3}) (\d+|-)'
APACHE_COMBINED = APACHE_COMMON + r' "([^"]*)" "([^"]*)"'
NGINX_ACCESS = (
    r'(\S+) - (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'
    r'(?:\s+"([^"]*)")?(?:\s+(\S+))?.*'
)
NGINX_CUSTOM = (
    r'(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}) - - \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+) "([^"]*)" '
    r'"([^"]*)" rt=(\d+\.\d+) uct="([^"]*)" uht="([^"]*)" urt="([^"]*)"'
)
NGINX_ERROR = (
    r'(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] (\d+)#(\d+): (.+?)'
    r'(?:, client: ([^\s,]+))?(?:, server: ([^\s,]+))?(?:, request: "([^"]*)")?'
    r'(?:, upstream: "[^"]*")?(?:, host: "([^"]*)")?(?:, referrer: "[^"]*")?'
)
SSH_AUTH = (
    r"(?i)(failed|accepted|invalid)\s+(password|publickey|keyboard-interactive)\s+for\s+"
    r"(?:invalid\s+user\s+)?(\S+)\s+from\s+(\S+)"
)
IPV4 = (
    r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
)
IPV6 = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
DOTTED_QUAD = r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
SYSLOG_HEAD = r"^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
PRIVATE_PREFIXES = ["127.", "10.", "192.168."] + [f"172.{n}." for n in range(16, 32)]
SUSPICIOUS_PATH_CHARS = r"""[<>"';(){}]"""
SPECIAL_CHARS = r"""[<>"';(){}\[\]&|*%$#@!?\\/+=~`^]"""
COMMON_AGENT_WORDS = ["Mozilla", "Chrome", "Safari", "Firefox", "Edge", "Opera"]

#: Literals of which a lower-cased text holds at least one if the rule matches;
#: looking for them first spares most texts the regular expression.
RULE_LITERALS = {
    "union_select": ["union"], "union_variations": ["un"], "boolean_logic": ["="], "tautology": ["=", "true", "false"],
    "javascript_events": ["="], "advanced_events": ["="],
    "time_delay_mysql": ["sleep", "benchmark"], "time_delay_mssql": ["waitfor"], "time_delay_postgresql": ["pg_sleep"],
    "error_functions": ["("], "cast_conversion": ["cast", "convert"], "stacked_queries": [";"],
    "information_schema": ["information_schema"], "mysql_functions": ["("],
    "mssql_functions": ["@@version", "db_name", "user_name", "system_user", "xp_cmdshell", "sp_executesql"],
    "sql_comments": ["--", "#", "/*"], "hex_encoding": ["0x"], "nosql_operators": ["$"], "mongodb_injection": ["$"],
    "script_tag": ["script"], "script_tag_with_src": ["script"], "javascript_scheme": ["javascript"],
    "data_scheme_html": ["text/html"], "javascript_eval": ["("], "css_expression": ["expression"], "svg_script": ["svg"],
    "svg_onload": ["svg"], "dom_manipulation": ["document.", "window."], "template_literals": ["`"],
    "prototype_pollution": ["proto"], "dynamic_import": ["import"], "css_import": ["@import"],
    "css_background_image": ["background"], "meta_refresh": ["meta"], "iframe_srcdoc": ["iframe"],
}

# A character that every match of a rule holds; each is looked for once for all its rules.
RULE_MARKS = {
    "(": [
        "time_delay_mysql", "time_delay_postgresql", "error_functions", "cast_conversion", "mysql_functions", "javascript_eval",
        "css_expression", "dynamic_import", "css_import"],
    "<": ["script_tag", "script_tag_with_src", "svg_script", "svg_onload", "meta_refresh", "iframe_srcdoc"],
    "$": ["nosql_operators", "mongodb_injection", "template_literals"],
    "=": ["boolean_logic", "javascript_events", "advanced_events"],
}
RULE_MARK = {name: mark for mark, names in RULE_MARKS.items() for name in names}

# Text that every match of a pattern holds, in this case.
PATTERN_LITERALS = {
    r"%[0-9a-fA-F]{2}": "%", r"&#x?[0-9a-fA-F]+;": "&#", r"\\x[0-9a-fA-F]{2}": "\\x", r"\\u[0-9a-fA-F]{4}": "\\u", r"\+": "+",
    r"\\[0-7]{1,3}": "\\", r"String\.fromCharCode\s*\(": "String.fromCharCode", r"unescape\s*\(": "unescape",
    r"decodeURI(?:Component)?\s*\(": "decodeURI", r"(?i)/\*!?\d*\s*\*/": "/*", r"(?i)sel\x00ect": "\x00", r"(?i)\+": "+",
}

# Shorter patterns that are found where one of the context's two is.
XSS_CONTEXT_SIGNS = {"HtmlAttribute": r"\w\s*=", "CssStyle": r"(?i)[a-z-]\s*:\s*[^;]|@(?:import|media|keyframes)"}
