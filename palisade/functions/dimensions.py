"""Reference data: places, attack context, hunts, indicators, advice texts.

Everything in this file is a fixed value: lookup tables and the texts shown
to analysts, which results repeat word for word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Address prefix -> country.
GEO_PREFIXES = [
    ("1.", "China"), ("27.", "China"), ("223.", "China"),
    ("46.", "Russia"), ("95.", "Russia"),
    ("175.45.176.", "North Korea"),
    ("192.168.", "Internal"), ("10.", "Internal"),
]

# Country -> code, display name, latitude, longitude.
COUNTRIES = [
    ("China", "CN", "China", 39.9042, 116.4074),
    ("Russia", "RU", "Russia", 55.7558, 37.6176),
    ("North Korea", "KP", "North Korea", 39.0392, 125.7625),
    ("Internal", "INT", "Internal Network", None, None),
    ("Unknown", "XX", "Unknown", None, None),
]

# Country -> code, assessment, usual attacks, known groups.
THREAT_INTEL = [
    ("China", "CN", "Alto - Conocido por actividad APT estatal y ciberespionaje",
     ["Advanced Persistent Threats (APT)", "Espionaje Industrial", "Ataques de Fuerza Bruta Masivos",
      "Robo de Propiedad Intelectual"],
     ["APT1 (Comment Crew)", "APT40 (Leviathan)", "Winnti Group", "APT41"]),
    ("Russia", "RU", "Alto - Asociado con cibercriminalidad organizada y operaciones estatales",
     ["Ransomware-as-a-Service", "Banking Trojans", "Operaciones de Influencia",
      "Ataques a Infraestructura Crítica"],
     ["APT28 (Fancy Bear)", "APT29 (Cozy Bear)", "Carbanak Group", "Evil Corp"]),
    ("North Korea", "KP", "Muy Alto - Operaciones dirigidas por el estado para financiamiento y espionaje",
     ["Cryptocurrency Theft", "SWIFT Banking Attacks", "Ransomware for Financial Gain",
      "Media and Entertainment Targeting"],
     ["Lazarus Group", "APT38", "Andariel", "BlueNoroff"]),
    ("Unknown/Various", "XX", "Medio - Requiere análisis adicional para determinar origen",
     ["Script Kiddies", "Automated Scanning", "Opportunistic Attacks"], ["Unknown"]),
]

# Event type -> what an analyst is told about it.
EVENT_CONTEXT = {
    "SqlInjection": dict(
        attack_name="Inyección SQL (SQL Injection)", difficulty_level="Intermedio-Avanzado",
        mitre_tactics=["Initial Access", "Exfiltration"],
        mitre_techniques=["T1190 - Exploit Public-Facing Application"],
        attack_vector="Web Application - Input Field SQL Injection via HTTP Parameters",
        vulnerability_id="CWE-89", cvss_score=8.8,
        triggered_rules=["SQL Injection Pattern Detection", "Database Function Call Detection"],
        mitigation_steps=[
            "Block source IP in firewall", "Review database logs for unauthorized access",
            "Implement prepared statements in application code", "Deploy Web Application Firewall (WAF)",
            "Implement Secure Development Lifecycle (SDLC)"],
        incidents=["Equifax Data Breach", "TalkTalk Cyber Attack"],
        indicators=[
            "SQL UNION keyword detected in parameters", "SQL comment syntax (--) found",
            "Single quote manipulation attempt", "Database function calls detected"]),
    "XssAttempt": dict(
        attack_name="Cross-Site Scripting (XSS)", difficulty_level="Intermedio",
        mitre_tactics=["Execution", "Credential Access"],
        mitre_techniques=["T1059 - Command and Scripting Interpreter"],
        attack_vector="Web Application - Client-Side Script Injection via User Input",
        vulnerability_id="CWE-79", cvss_score=6.1,
        triggered_rules=["XSS Script Tag Detection"],
        mitigation_steps=[
            "Enable Content Security Policy (CSP)", "Implement proper output encoding",
            "Regular security testing and code reviews"],
        incidents=["Twitter XSS Worm", "MySpace Samy Worm"],
        indicators=[
            "JavaScript <script> tags detected", "HTML event handlers (onclick, onerror) found",
            "URL encoding of malicious scripts", "DOM manipulation attempts"]),
    "BruteForce": dict(
        attack_name="Ataque de Fuerza Bruta", difficulty_level="Básico-Intermedio",
        mitre_tactics=["Credential Access", "Initial Access"],
        mitre_techniques=["T1110 - Brute Force", "T1078 - Valid Accounts"],
        attack_vector="Network Service - Authentication Endpoint Credential Guessing",
        vulnerability_id=None, cvss_score=5.3,
        triggered_rules=["Multiple Authentication Failures"], mitigation_steps=[], incidents=[],
        indicators=[
            "Repeated authentication failures", "Common password patterns detected",
            "High-frequency requests from single IP", "Dictionary attack indicators"]),
    "Anomaly": dict(
        attack_name="Detección de Anomalías con ML", difficulty_level="Avanzado",
        mitre_tactics=["Defense Evasion", "Discovery"],
        mitre_techniques=["T1055 - Process Injection", "T1083 - File and Directory Discovery"],
        attack_vector="Multiple Vectors - Behavioral Anomaly Detection Trigger",
        vulnerability_id=None, cvss_score=None, triggered_rules=[], mitigation_steps=[], incidents=[],
        indicators=[
            "Statistical deviation from baseline behavior", "Unusual access patterns detected",
            "Abnormal data volume transfer", "Time-based behavioral anomalies"]),
    "*": dict(
        attack_name="Evento de Seguridad General", difficulty_level="Variable",
        mitre_tactics=["Various"], mitre_techniques=["Multiple techniques possible"],
        attack_vector="Unknown - Multiple Attack Vectors Possible",
        vulnerability_id=None, cvss_score=None, triggered_rules=[], mitigation_steps=[], incidents=[],
        indicators=["General suspicious activity indicators"]),
}

# Shipped hunts.
HUNTS = [
    ("hunt_001", "Exfiltración de Datos Fuera de Horario", "Data Exfiltration", "High", "HypothesisDriven",
     ["T1041", "T1005"], 0.6, 72),
    ("hunt_002", "Actividad APT - Movimiento Lateral", "APT Detection", "Critical", "APTHunting",
     ["T1078", "T1021"], 0.7, 168),
    ("hunt_003", "IOCs de Malware Conocido", "IOC Hunting", "Critical", "IndicatorBased",
     ["T1071", "T1090"], 0.8, 24),
]

# Shipped indicators; ages in days before the reference time.
INDICATORS = [
    ("ioc_001", "IpAddress", "203.0.113.45", "HIGH", 30, 1, ["Mirai Botnet"], ["T1110"]),
    ("ioc_002", "Domain", "malicious-c2.example.com", "CRITICAL", 60, 5, ["APT28", "Fancy Bear"],
     ["T1071", "T1105"]),
]

# Login behaviour pattern.
LOGIN_PATTERN = dict(
    id="pattern_001", avg_daily_logins=50.0, peak_hour_logins=15.0, failed_login_rate=0.05, sigmas=3.0,
    window_hours=1, techniques=["T1110", "T1078"])

# Technique -> advice.
TECHNIQUE_MITIGATIONS = {
    "T1190": ["Aplicar patches de seguridad inmediatamente", "Implementar Web Application Firewall (WAF)",
              "Realizar testing de penetración regular"],
    "T1110": ["Implementar autenticación multifactor (MFA)", "Configurar bloqueo automático de cuentas",
              "Utilizar CAPTCHA después de intentos fallidos"],
    "T1059": ["Implementar Content Security Policy (CSP)", "Sanitizar todas las entradas de usuario",
              "Usar frameworks que escapen automáticamente el output"],
}

# Advice after an SQL injection.
SQLI_GENERAL_ADVICE = [
    "Implementar prepared statements/parameterized queries",
    "Validar y sanitizar todas las entradas de usuario",
    "Aplicar principio de menor privilegio en base de datos",
    "Implementar Web Application Firewall (WAF)",
]
SQLI_TYPE_ADVICE = {
    "Union": ["Filtrar palabras clave UNION y SELECT en entradas",
              "Limitar resultado de queries a un solo conjunto"],
    "Time": ["Implementar timeouts en queries de base de datos",
             "Monitorear tiempo de respuesta de queries"],
    "Error": ["Suprimir mensajes de error detallados en producción",
              "Implementar logging centralizado de errores"],
    "NoSql": ["Validar tipos de datos en queries NoSQL", "Evitar evaluación de JavaScript en MongoDB"],
}
SQLI_ENCODING_ADVICE = [
    "Implementar decodificación y normalización de entradas",
    "Validar entradas después de decodificación completa",
]

# Advice after a cross-site scripting attempt.
XSS_GENERAL_ADVICE = [
    "Implementar Content Security Policy (CSP) restrictivo",
    "Escapar todos los datos de salida según el contexto",
    "Validar y sanitizar todas las entradas de usuario",
    "Usar frameworks que escapen automáticamente (React, Angular)",
    "Implementar HTTP security headers (X-XSS-Protection, X-Content-Type-Options)",
]
XSS_TYPE_ADVICE = {
    "Reflected": ["Validar parámetros URL y formularios en servidor",
                  "Usar encoding contextual para datos reflejados"],
    "Dom": ["Evitar uso de innerHTML, usar textContent o innerText",
            "Validar datos antes de manipulación DOM", "Usar bibliotecas de templating seguras"],
    "PrototypePollution": ["Usar Object.create(null) para objetos sin prototipo",
                           "Validar claves de objeto antes de asignación",
                           "Implementar controles de integridad de prototipos"],
}
XSS_CONTEXT_ADVICE = {
    "HtmlContent": ["Usar HTML encoding para contenido dinámico",
                    "Implementar whitelist de tags HTML permitidos"],
    "HtmlAttribute": ["Usar attribute encoding para valores de atributos",
                      "Validar nombres de atributos contra whitelist"],
    "JavascriptString": ["Usar JavaScript string encoding", "Evitar concatenación directa en strings JS"],
    "JavascriptCode": ["Nunca concatenar datos de usuario en código JavaScript",
                       "Usar JSON.stringify para datos estructurados"],
    "CssStyle": ["Usar CSS encoding para valores de propiedades", "Whitelist de propiedades CSS permitidas"],
    "UrlParameter": ["Usar URL encoding para parámetros dinámicos", "Validar esquemas de URL permitidos"],
    "SvgContent": ["Sanitizar contenido SVG estrictamente", "Remover elementos script de SVG uploads"],
}
XSS_ENCODING_ADVICE = ["Implementar decodificación recursiva en validación",
                       "Normalizar entradas antes de validación"]
XSS_FUNCTION_ADVICE = ["Implementar CSP para bloquear JavaScript inline",
                       "Usar Trusted Types API para prevenir inyección DOM"]
XSS_OBFUSCATION_ADVICE = ["Implementar detección de obfuscación en WAF",
                          "Monitorear patrones de encoding múltiple"]

# Advice after brute force.
BRUTE_GENERAL_ADVICE = [
    "Implementar rate limiting por IP y usuario",
    "Configurar account lockout después de intentos fallidos",
    "Implementar CAPTCHA después de múltiples fallos",
    "Usar autenticación multi-factor (MFA)",
    "Monitorear y alertar sobre patrones de fuerza bruta",
]
BRUTE_TYPE_ADVICE = {
    "Authentication": ["Implementar progressive delays en login", "Usar políticas de contraseñas fuertes",
                       "Implementar detección de credenciales comprometidas"],
    "Directory": ["Ocultar directorios sensibles del público",
                  "Implementar autenticación para directorios administrativos",
                  "Usar custom error pages para ocultar estructura"],
    "Api": ["Implementar API rate limiting estricto", "Usar API keys con rotación automática",
            "Implementar OAuth 2.0 con refresh tokens"],
    "Database": ["Configurar account lockout en base de datos", "Usar conexiones cifradas para DB",
                 "Implementar auditoría de acceso a DB"],
}
BRUTE_BLOCK_ADVICE = "Bloquear IP {} inmediatamente"
BRUTE_MULTI_SERVICE_ADVICE = ["Implementar correlación de eventos entre servicios",
                              "Configurar alertas para ataques multi-servicio"]
BRUTE_REPUTATION_ADVICE = ["Consultar listas de reputación de IPs",
                           "Implementar geo-blocking para regiones de alto riesgo"]
BRUTE_SERVICE_ADVICE = ["Activar modo de protección para servicio {}",
                        "Implementar failover automático si disponible"]
BRUTE_PEAK_ADVICE = ["Implementar DDoS protection/CDN", "Configurar circuit breakers para protección"]

# Advice by anomaly risk, and by the feature that stands out.
ANOMALY_RISK_ADVICE = {
    "Critical": ["CRÍTICO: Investigar inmediatamente", "Bloquear tráfico sospechoso si es posible",
                 "Alertar al equipo de seguridad"],
    "High": ["ALTO: Revisar en las próximas 2 horas", "Monitorear actividad relacionada"],
    "Medium": ["MEDIO: Revisar durante el día", "Documentar para análisis de tendencias"],
    "Low": ["BAJO: Monitoreo rutinario"],
}
ANOMALY_FEATURE_ADVICE = [
    ("payload_entropy", "Analizar payload por posible obfuscación"),
    ("request_frequency", "Implementar rate limiting para esta IP"),
    ("user_agent", "Verificar legitimidad del User-Agent"),
    ("response_time", "Investigar posible ataque de timing"),
]

# Alert routing by severity, queue limits.
ROUTING = {"Critical": ["console", "email", "webhook"], "Warning": ["console", "webhook"], "Info": ["console"]}
BATCH_MINUTES, BATCH_SIZE, DEDUP_MINUTES = 10, 20, 30
EMAIL_LIMIT_PER_HOUR, WEBHOOK_LIMIT_PER_MINUTE = 60, 60
NO_RETRY_STATUS = [400, 401, 403, 404, 422]
RETRY_ATTEMPTS, RETRY_SECONDS, RETRY_FACTOR, RETRY_MAX_SECONDS = 3, 30, 2.0, 3600


def geo(spark: SparkSession) -> DataFrame:
    places = {c: rest for c, *rest in COUNTRIES}
    rows = [(p, c, *places[c]) for p, c in GEO_PREFIXES]
    return spark.createDataFrame(rows, "prefix string, country string, code string, name string, lat double, lon double")


def hunts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        HUNTS, "id string, name string, category string, severity string, hunt_type string, "
        "techniques array<string>, confidence_threshold double, window_hours int")


def indicators(spark: SparkSession, as_of: str) -> DataFrame:
    df = spark.createDataFrame(
        INDICATORS, "id string, ioc_type string, value string, threat_level string, first_days int, "
        "last_days int, campaigns array<string>, techniques array<string>")
    return df.selectExpr(
        "id", "ioc_type", "value", "threat_level",
        f"TIMESTAMP '{as_of}' - make_dt_interval(first_days) AS first_seen",
        f"TIMESTAMP '{as_of}' - make_dt_interval(last_days) AS last_seen", "campaigns", "techniques")


def event_context(spark: SparkSession) -> DataFrame:
    rows = [(t, *[c[k] for k in next(iter(EVENT_CONTEXT.values()))]) for t, c in EVENT_CONTEXT.items()]
    return spark.createDataFrame(
        rows, "event_type string, attack_name string, difficulty_level string, mitre_tactics array<string>, "
        "mitre_techniques array<string>, attack_vector string, vulnerability_id string, cvss_score double, "
        "triggered_rules array<string>, mitigation_steps array<string>, incidents array<string>, "
        "indicators array<string>")


def threat_intel(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        THREAT_INTEL, "country string, country_code string, risk_assessment string, "
        "attack_types array<string>, actor_groups array<string>")


def routing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, c, i) for s, cs in ROUTING.items() for i, c in enumerate(cs)], "severity string, channel string, position int")
