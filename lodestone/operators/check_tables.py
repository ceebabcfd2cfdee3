"""Tables of checks: one row per rule id and its patterns, run by ``checks``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Check:
    """A check of one family of files.

    patterns: Python patterns, each reported where it matches.  has, hasnt:
    texts one of which, or none of which, the file must hold.  path: a part of
    the lower-cased path.  only: at most so many matches of a pattern.
    around and near: characters around a match, and texts of which it must
    hold none there.  within: texts of which the match must hold one.
    above: patterns report once, at line 1, if they match more often.
    absent: reported at line 1 of files that have none of ``hasnt``.
    raised: severity where the surroundings hold one of ``raised_by``.
    """

    rule_id: str
    title: str
    severity: str
    confidence: str
    cwe: str
    owasp: str
    patterns: tuple[str, ...] = ()
    flags: str = ""
    has: tuple[str, ...] = ()
    hasnt: tuple[str, ...] = ()
    path: str = ""
    only: int = 0
    around: tuple[int, int] = (0, 0)
    near: tuple[str, ...] = ()
    within: tuple[str, ...] = ()
    above: int = 0
    absent: bool = False
    raised: str = ""
    raised_by: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()


# All rule ids, grades and patterns below.
GO = (
    Check("GO-SQL_-002", "Potential Sql Injection", "high", "low", "CWE-89", "A03", (
        r"(?:Query|QueryRow|Exec|Prepare)\s*\(\s*(?:fmt\.Sprintf|.*\+)", r'db\.\w+\(\s*"[^"]*"\s*\+', r"Raw\s*\(\s*(?:fmt\.Sprintf|.*\+)", r"\.(?:Query|QueryRow|Exec)\s*\(\s*\w+\s*[,)]"), "im"),
    Check("GO-COMM-002", "Potential Command Injection", "critical", "low", "CWE-78", "A03", (
        r"exec\.Command\s*\([^)]*(?:\+|fmt\.Sprintf)", r"exec\.CommandContext\s*\([^)]*(?:\+|fmt\.Sprintf)", r'exec\.Command\s*\(\s*"(?:sh|bash|cmd)"\s*,\s*"-c"\s*,',
        r"exec\.Command\s*\([^)]+\)\.(?:Output|Run|Start|CombinedOutput)"), "im"),
    Check("GO-PATH-002", "Potential Path Traversal", "high", "low", "CWE-22", "A01", (
        r"(?:Open|ReadFile|WriteFile)\s*\([^)]*(?:\+|filepath\.Join\s*\([^)]*r\.)", r"filepath\.Join\s*\([^)]*(?:r\.|c\.)"), "im"),
    Check("GO-SSRF-002", "Potential Ssrf", "high", "low", "CWE-918", "A10", (
        r"http\.(?:Get|Post|PostForm)\s*\([^)]*(?:\+|fmt\.Sprintf)", r"NewRequest(?:WithContext)?\s*\([^)]*(?:\+|fmt\.Sprintf)", r"http\.(?:Get|Post|PostForm|Head)\s*\(\s*\w+\s*\)"), "im"),
    Check("GO-HARD-002", "Potential Hardcoded Secret", "high", "low", "CWE-798", "A07", (
        r"""(?:password|secret|apikey|api_key|token)\s*[=:]\s*["\'][^"\']{8,}["\']""", r"(?:BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY)"), "im"),
    *(Check("GO-CRYPTO-001", "Weak Cryptographic Algorithm", "medium", "high", "CWE-327", "A02", (rf'import\s+"{p}"|import\s+\(\s*[^)]*"{p}"[^)]*\)',), "m", only=1)
      for p in ("crypto/md5", "crypto/sha1", "crypto/des", "crypto/rc4")),
)
CSHARP = (
    Check("CS-SQLI-001", "Potential SQL Injection", "high", "medium", "CWE-89", "A03", (
        r"(?:ExecuteReader|ExecuteNonQuery|ExecuteScalar|SqlCommand)\s*\([^)]*\+", r"(?:FromSql|FromSqlRaw)\s*\(\s*\$", r"(?:ExecuteSqlCommand|ExecuteSqlRaw)\s*\([^)]*\+",
        r"(?:ExecuteSqlCommand|ExecuteSqlRaw)\s*\(\s*\$", r"new\s+SqlCommand\s*\([^)]*\+")),
    Check("CS-CMDI-001", "Potential Command Injection", "critical", "medium", "CWE-78", "A03", (r"Process\.Start\s*\([^)]*\+", r"ProcessStartInfo\s*\{[^}]*Arguments\s*=\s*[^}]*\+"), "s"),
    Check("CS-DESER-001", "Insecure Deserialization", "critical", "high", "CWE-502", "A08", ("BinaryFormatter", "ObjectStateFormatter", "NetDataContractSerializer", "SoapFormatter")),
    Check("CS-XXE-001", "Potential XXE Vulnerability", "high", "medium", "CWE-611", "A05", (r"(?:XmlDocument|XmlReader)",), hasnt=("DtdProcessing.Prohibit", "XmlResolver = null"), only=1),
    Check("CS-CRYPTO-001", "Weak Cryptographic Algorithm", "medium", "high", "CWE-327", "A02",
          tuple(rf"{a}\.Create|{a}CryptoServiceProvider|{a}Managed" for a in ("MD5", "SHA1", "DES", "TripleDES", "RC2"))),
    Check("CS-SECRET-001", "Hardcoded Secret", "high", "medium", "CWE-798", "A07", (
        r"""(?:password|pwd|secret|apikey|api_key|connectionstring)\s*=\s*["\'][^"\']{8,}["\']""", r"(?:BEGIN\s+(?:RSA\s+)?PRIVATE\s+KEY)"), "i"),
)
KOTLIN = (
    Check("KT-SQLI-001", "Potential SQL Injection", "high", "medium", "CWE-89", "A03", (r"rawQuery\s*\([^)]*\$", r"rawQuery\s*\([^)]*\+", r"execSQL\s*\([^)]*\$", r"@RawQuery")),
    Check("KT-CMDI-001", "Potential Command Injection", "high", "medium", "CWE-78", "A03", (
        r"Runtime\.getRuntime\s*\(\s*\)\.exec\s*\(", r"ProcessBuilder\s*\([^)]*\)\.start\s*\(\s*\)", r"ProcessBuilder\s*\([^)]*\)")),
    Check("KT-INTENT-001", "Potential Intent Vulnerability", "medium", "low", "CWE-927", "A01", (r"Intent\s*\(\s*\)", r"Intent\s*\([^)]*\)\s*\.apply\s*\{[^}]*putExtra"), "s", has=("startActivity", "sendBroadcast")),
    Check("KT-WEBVIEW-001", "WebView JavaScript Enabled", "medium", "medium", "CWE-79", "A03", (
        r"setJavaScriptEnabled\s*\(\s*true\s*\)", r"javaScriptEnabled\s*=\s*true", r"\.settings\.javaScriptEnabled\s*=\s*true")),
    Check("KT-WEBVIEW-002", "WebView JavaScript Bridge", "high", "high", "CWE-749", "A03", (r"addJavascriptInterface",)),
    Check("KT-STORAGE-001", "Insecure File Storage", "high", "high", "CWE-276", "A01", (r"MODE_WORLD_READABLE", r"MODE_WORLD_WRITEABLE", r"Context\.MODE_PRIVATE.*0")),
    Check("KT-SECRET-001", "Hardcoded Secret", "high", "medium", "CWE-798", "A07", (
        r'(?:API_KEY|SECRET|PASSWORD|TOKEN)\s*=\s*"[^"]{8,}"', r'val\s+(?:apiKey|secret|password|token)\s*=\s*"[^"]{8,}"'), "i"),
    Check("KT-CRYPTO-001", "Weak Cryptographic Algorithm", "medium", "medium", "CWE-327", "A02", ("MD5", "SHA1", "DES", "ECB")),
)
PHP = (
    Check("PHP-SQLI-001", "SQL Injection", "critical", "high", "CWE-89", "A03", (
        r"(?:mysql_query|mysqli_query|pg_query)\s*\([^)]*\$_(?:GET|POST|REQUEST)", r"->(?:query|exec)\s*\([^)]*\$_(?:GET|POST|REQUEST)", r"(?:whereRaw|selectRaw|orderByRaw|DB::raw)\s*\([^)]*\$",
        r"(?:mysql_query|mysqli_query|pg_query)\s*\([^)]*\.\s*\$\w+", r'(?:mysql_query|mysqli_query|pg_query)\s*\([^)]*"\s*\.\s*\$')),
    Check("PHP-CMDI-001", "Command Injection", "critical", "high", "CWE-78", "A03", (
        r"(?:exec|shell_exec|system|passthru|popen)\s*\([^)]*\$_(?:GET|POST|REQUEST)", r"`[^`]*\$_(?:GET|POST|REQUEST)")),
    Check("PHP-XSS-001", "Cross-Site Scripting (XSS)", "high", "high", "CWE-79", "A03", (
        r"echo\s+\$_(?:GET|POST|REQUEST)\[", r"print\s+\$_(?:GET|POST|REQUEST)\[", r"<?=\s*\$_(?:GET|POST|REQUEST)\[")),
    Check("PHP-LFI-001", "Local/Remote File Inclusion", "critical", "high", "CWE-98", "A03", (
        r"(?:include|require)(?:_once)?\s*\([^)]*\$_(?:GET|POST|REQUEST)", r"(?:include|require)(?:_once)?\s+\$_(?:GET|POST|REQUEST)")),
    Check("PHP-DESER-001", "Insecure Deserialization", "critical", "high", "CWE-502", "A08", (r"unserialize\s*\([^)]*\$_(?:GET|POST|REQUEST|COOKIE)", r"unserialize\s*\(\s*\$")),
    Check("PHP-CODEINJ-001", "Code Injection", "critical", "medium", "CWE-94", "A03", (
        r"eval\s*\([^)]*\$", r"assert\s*\([^)]*\$", r"create_function\s*\(", r"""preg_replace\s*\([^)]*["\']/[^/]*e[^"\']*["\']""")),
)
RUBY = (
    Check("RUBY-SQLI-001", "SQL Injection", "high", "high", "CWE-89", "A03", (
        r"find_by_sql\s*\([^)]*#\{", r"\.where\s*\([^)]*#\{", r'\.where\s*\(\s*"[^"]*#\{', r"execute\s*\([^)]*#\{", r"\.order\s*\([^)]*params\[")),
    Check("RUBY-CMDI-001", "Command Injection", "critical", "high", "CWE-78", "A03", (
        r"system\s*\([^)]*#\{", r"system\s*\([^)]*params\[", r"`[^`]*#\{", r"exec\s*\([^)]*#\{", r"%x\[[^\]]*#\{", r"%x\{[^}]*#\{")),
    Check("RUBY-XSS-001", "Cross-Site Scripting (XSS)", "high", "medium", "CWE-79", "A03", (r"\.html_safe", r"raw\s*\([^)]*params\[", r"<%=\s*raw")),
    Check("RUBY-DESER-001", "Insecure Deserialization", "high", "medium", "CWE-502", "A08", (r"YAML\.load\s*\(", r"Marshal\.load\s*\(")),
    Check("RUBY-MASS-001", "Mass Assignment Vulnerability", "high", "high", "CWE-915", "A01", (r"permit!",)),
    Check("RUBY-REDIRECT-001", "Open Redirect", "medium", "medium", "CWE-601", "A01", (r"redirect_to\s+params\[", r"redirect_to\s+request\.")),
)
RUST = (
    Check("RUST-UNSAFE-001", "Unsafe Code Block", "medium", "high", "CWE-119", "A06", (r"unsafe\s+\{", r"unsafe\s+fn\s+", r"unsafe\s+impl\s+")),
    Check("RUST-UNSAFE-002", "Dangerous Unsafe Operation", "high", "high", "CWE-119", "A06", (r"std::mem::transmute", r"from_raw_parts", r"std::ptr::read", r"std::ptr::write")),
    Check("RUST-SQLI-001", "Potential SQL Injection", "high", "medium", "CWE-89", "A03", (r"(?:query|execute)\s*\(\s*&?format!", r"sql!\s*\([^)]*\{", r"\.query\s*\([^)]*\+")),
    Check("RUST-CMDI-001", "Potential Command Injection", "high", "medium", "CWE-78", "A03", (
        r'Command::new\s*\(\s*"(?:sh|bash|cmd)"\s*\)', r'Command::new\s*\([^)]*\)\s*\.arg\s*\(\s*"-c"\s*\)', r"Command::new\s*\(\s*&?format!", r"\.arg\s*\(\s*&?format!")),
    Check("RUST-PANIC-001", "Excessive unwrap() Usage", "low", "low", "CWE-754", "A06", (r"\.unwrap\(\)",), hasnt=("#[cfg(test)]", "#[test]"), above=5),
    Check("RUST-FMT-001", "Potential Format String Vulnerability", "medium", "low", "CWE-134", "A03", (r'format!\s*\(\s*[^"]+\)', r'println!\s*\(\s*[^"]+\)'), within=("&", "var")),
)
SWIFT = (
    Check("SWIFT-SQLI-001", "Potential SQL Injection", "high", "medium", "CWE-89", "A03", (
        r"sqlite3_exec\s*\([^)]*\\?\([^)]*\)", r"sqlite3_exec\s*\([^,]+,\s*\w+", r"sqlite3_prepare\s*\([^)]*\\?\(", r'(?:SELECT|INSERT|UPDATE|DELETE)[^"]*\\?\([^)]*\)'), "i"),
    Check("SWIFT-CMDI-001", "Potential Command Injection", "high", "medium", "CWE-78", "A03", (r"Process\s*\(\s*\)", r"process\.executableURL", r"process\.arguments\s*=", r"NSTask\s*\(\s*\)")),
    Check("SWIFT-DESER-001", "Insecure Deserialization", "high", "medium", "CWE-502", "A08", (r"NSKeyedUnarchiver\.unarchiveObject", r"NSKeyedUnarchiver\.unarchivedObject", r"NSUnarchiver")),
    Check("SWIFT-SSRF-001", "Potential SSRF", "high", "medium", "CWE-918", "A10", (
        r"URLSession\.shared\.dataTask\s*\(\s*with:\s*\w+", r"URLSession\.shared\.data\s*\(\s*from:\s*\w+", r"URL\s*\(\s*string:\s*\w+\s*\)")),
    Check("SWIFT-ATS-001", "App Transport Security Bypass", "high", "high", "CWE-319", "A02", (
        r"NSAllowsArbitraryLoads", r"NSExceptionAllowsInsecureHTTPLoads", r"NSTemporaryExceptionAllowsInsecureHTTPLoads")),
    Check("SWIFT-KEYCHAIN-001", "Insecure Keychain Access", "high", "high", "CWE-522", "A07", ("kSecAttrAccessibleAlways", "kSecAttrAccessibleAlwaysThisDeviceOnly"), has=("SecItemAdd", "SecItemUpdate")),
    Check("SWIFT-WEBVIEW-001", "Deprecated UIWebView", "medium", "high", "CWE-829", "A06", (r"UIWebView",)),
    Check("SWIFT-WEBVIEW-002", "WebView JavaScript Injection", "high", "medium", "CWE-79", "A03", (r"evaluateJavaScript\s*\([^)]*\\\(",)),
    Check("SWIFT-URL-001", "URL Scheme Handler", "medium", "low", "CWE-939", "A01", (r"func\s+application\s*\([^)]*open\s+url:", r"handleOpenURL"),
          has=("application(_:open:", "handleOpenURL"), around=(0, 500), near=("scheme", "host")),
    Check("SWIFT-SECRET-001", "Hardcoded Secret", "high", "medium", "CWE-798", "A07", (r'(?:let|var)\s+(?:apiKey|secret|password|token)\s*=\s*"[^"]{8,}"', r'API_KEY\s*=\s*"[^"]{8,}"'), "i"),
    Check("SWIFT-CRYPTO-001", "Weak Cryptographic Algorithm", "medium", "high", "CWE-327", "A02", ("CC_MD5", "CC_SHA1", "kCCAlgorithmDES", "kCCAlgorithm3DES")),
    Check("SWIFT-RANDOM-001", "Insecure Random", "low", "medium", "CWE-330", "A02", (r"arc4random\(\)",), hasnt=("arc4random_uniform",)),
)
LANGUAGES = {"go": ((".go",), GO), "csharp": ((".cs",), CSHARP), "kotlin": ((".kt", ".kts"), KOTLIN), "php": ((".php", ".phtml", ".php5", ".php7"), PHP), "ruby": ((".rb", ".rake", ".erb"), RUBY), "rust": ((".rs",), RUST), "swift": ((".swift",), SWIFT)}

TERRAFORM = tuple(Check(f"TF-{k.upper()[:8]}", title, severity, "high", cwe, "A05", (pattern,), "is") for k, title, severity, cwe, pattern in (
    ("public_s3", "Public S3 Bucket", "critical", "CWE-284", r"""acl\s*=\s*["\']public-read"""),
    ("unencrypted_s3", "Unencrypted S3 Bucket", "high", "CWE-311", r'resource\s*"aws_s3_bucket"\s*"[^"]+"\s*\{[^}]*\}(?![^}]*server_side_encryption)'),
    ("open_ingress", "Open Security Group", "high", "CWE-284", r"""cidr_blocks\s*=\s*\[\s*["\']0\.0\.0\.0/0["\']"""),
    ("all_ports_open", "All Ports Open", "critical", "CWE-284", r"from_port\s*=\s*0[^}]*to_port\s*=\s*65535"),
    ("permissive_iam", "Overly Permissive IAM", "high", "CWE-269", r'(?:"Action"\s*:\s*"\*"|Action\s*=\s*"\*")'),
    ("iam_star_resource", "IAM Policy with Star Resource", "medium", "CWE-269", r'(?:"Resource"\s*:\s*"\*"|Resource\s*=\s*"\*")'),
    ("public_rds", "Public RDS Instance", "high", "CWE-284", r"publicly_accessible\s*=\s*true"),
    ("unencrypted_rds", "Unencrypted RDS Storage", "high", "CWE-311", r"storage_encrypted\s*=\s*false"),
    ("unencrypted_ebs", "Unencrypted EBS Volume", "high", "CWE-311", r"encrypted\s*=\s*false"),
    ("cloudtrail_disabled", "Logging Disabled", "medium", "CWE-778", r"enable_logging\s*=\s*false"),
    ("hardcoded_password", "Hardcoded Secret", "critical", "CWE-798", r"""(?:password|secret|api_key)\s*=\s*["\'][^$][^"\']{8,}["\']"""),
))
KUBERNETES = tuple(Check(f"K8S-{k.upper()[:8]}", title, severity, "high", cwe, "A05", (pattern,), "im") for k, title, severity, cwe, pattern in (
    ("privileged_container", "Privileged Container", "critical", "CWE-250", r"privileged:\s*true"),
    ("run_as_root", "Container Running as Root", "high", "CWE-250", r"runAsUser:\s*0"),
    ("no_resource_limits", "Missing Resource Limits", "medium", "CWE-770", r"containers:\s*\n\s*-[^}]*(?!limits:)"),
    ("host_network", "Host Network Enabled", "high", "CWE-284", r"hostNetwork:\s*true"),
    ("host_pid", "Host PID Enabled", "high", "CWE-284", r"hostPID:\s*true"),
    ("host_path", "HostPath Volume", "medium", "CWE-284", r"hostPath:\s*\n\s*path:"),
    ("allow_privilege_escalation", "Privilege Escalation Allowed", "high", "CWE-269", r"allowPrivilegeEscalation:\s*true"),
    ("capabilities_all", "All Capabilities Added", "critical", "CWE-250", r"capabilities:\s*\n\s*add:\s*\n\s*-\s*ALL"),
    ("capabilities_dangerous", "Dangerous Capability Added", "high", "CWE-250", r"capabilities:\s*\n\s*add:\s*\n\s*-\s*(?:SYS_ADMIN|NET_ADMIN|SYS_PTRACE|DAC_OVERRIDE)"),
    ("no_readonly_root", "Writable Root Filesystem", "low", "CWE-732", r"readOnlyRootFilesystem:\s*false"),
    ("automount_token", "Service Account Token Auto-mounted", "low", "CWE-269", r"automountServiceAccountToken:\s*true"),
    ("default_namespace", "Using Default Namespace", "low", "CWE-1188", r"namespace:\s*default"),
    ("latest_image", "Using Latest Image Tag", "low", "CWE-1104", r"image:\s*[^\s:]+:latest"),
    ("hardcoded_secret", "Hardcoded Secret", "critical", "CWE-798", r"""(?:password|secret|api_key|token):\s*["\']?[^$\s][^\s"\']{8,}"""),
))
DOCKERFILE = (
    Check("DOCKER-ROOT-001", "Running as Root", "high", "high", "CWE-250", "A05", hasnt=("USER",), absent=True),
    *(Check(f"DOCKER-{k.upper()[:6]}", title, severity, "high", cwe, "A05", (pattern,), "im") for k, title, severity, cwe, pattern in (
        ("latest_tag", "Using Latest Tag", "medium", "CWE-1104", r"FROM\s+\S+:latest"),
        ("add_instead_of_copy", "ADD Instead of COPY", "low", "CWE-1188", r"^ADD\s+(?!https?://)"),
        ("hardcoded_secret", "Hardcoded Secret", "critical", "CWE-798", r"""(?:ENV|ARG)\s+(?:\w*(?:PASSWORD|SECRET|KEY|TOKEN)\w*)\s*=\s*["\']?[^$\s][^\s"\']{8,}"""),
        ("expose_ssh", "SSH Port Exposed", "medium", "CWE-284", r"EXPOSE\s+22"),
        ("apt_no_clean", "APT Cache Not Cleaned", "low", "CWE-1188", r"apt-get\s+install(?!.*&&.*rm\s+-rf)"),
        ("curl_bash", "Curl Pipe to Shell", "high", "CWE-494", r"curl.*\|\s*(?:bash|sh)"),
        ("sudo_usage", "Sudo in Dockerfile", "medium", "CWE-250", r"RUN\s+.*sudo\s+"),
    )),
)
CLOUDFORMATION = tuple(Check(f"CFN-{k.upper()[:8]}", title, severity, "high", cwe, "A05", (pattern,), "i") for k, title, severity, cwe, pattern in (
    ("public_s3", "Public S3 Bucket", "critical", "CWE-284", r"AccessControl:\s*(?:PublicRead|PublicReadWrite)"),
    ("open_security_group", "Open Security Group", "high", "CWE-284", r"""CidrIp:\s*["\']?0\.0\.0\.0/0"""),
    ("public_rds", "Public RDS", "high", "CWE-284", r"""PubliclyAccessible:\s*(?:true|["\']true["\'])"""),
    ("unencrypted_storage", "Unencrypted Storage", "high", "CWE-311", r"""StorageEncrypted:\s*(?:false|["\']false["\'])"""),
    ("hardcoded_secret", "Hardcoded Secret", "critical", "CWE-798", r"""(?:Password|Secret|ApiKey):\s*["\'][^!][^"\']{8,}["\']"""),
))

_SQL = r"\.raw\s*\(\s*f[\"\']", r"\.raw\s*\([^)]*%", r"\.extra\s*\([^)]*where\s*=", r"cursor\.execute\s*\([^)]*%", r"cursor\.execute\s*\(\s*f[\"\']"
_MARK_SAFE = r"mark_safe\s*\(\s*\w+\s*\)", r"SafeString\s*\(\s*\w+\s*\)"
DJANGO = (
    Check("DJANGO-SQLI-001", "SQL Injection", "critical", "high", "CWE-89", "A03", _SQL, extensions=(".py",)),
    Check("DJANGO-CONFIG-001", "Debug Mode Enabled", "high", "high", "CWE-215", "A05", (r"DEBUG\s*=\s*True",), path="settings", only=1, extensions=(".py",)),
    Check("DJANGO-SECRET-001", "Hardcoded SECRET_KEY", "high", "high", "CWE-798", "A07", (r"SECRET_KEY\s*=\s*[\"\'][^\"\']{20,}[\"\']",), path="settings", extensions=(".py",)),
    Check("DJANGO-CSRF-001", "CSRF Protection Disabled", "medium", "high", "CWE-352", "A01", (r"@csrf_exempt",), extensions=(".py",)),
    Check("DJANGO-CLICK-001", "Missing Clickjacking Protection", "medium", "medium", "CWE-1021", "A05", hasnt=("X_FRAME_OPTIONS", "XFrameOptionsMiddleware"), path="settings", absent=True, extensions=(".py",)),
    Check("DJANGO-XSS-001", "Template XSS", "high", "medium", "CWE-79", "A03", (r"\{\{\s*\w+\s*\|\s*safe\s*\}\}", r"\{%\s*autoescape\s+off\s*%\}"), extensions=(".html",)),
    Check("DJANGO-XSS-002", "Unsafe mark_safe Usage", "high", "medium", "CWE-79", "A03", _MARK_SAFE, extensions=(".py", ".html")),
)
FLASK = (
    Check("FLASK-CONFIG-001", "Debug Mode Enabled", "high", "high", "CWE-215", "A05", (r"\.run\s*\([^)]*debug\s*=\s*True", r"DEBUG\s*=\s*True", r"app\.debug\s*=\s*True"), extensions=(".py",)),
    Check("FLASK-SECRET-001", "Hardcoded Secret Key", "high", "high", "CWE-798", "A07", (r"SECRET_KEY\s*=\s*[\"\'][^\"\']{8,}[\"\']", r"app\.secret_key\s*=\s*[\"\'][^\"\']+[\"\']"), extensions=(".py",)),
    Check("FLASK-SQLI-001", "SQL Injection", "critical", "high", "CWE-89", "A03", (r"execute\s*\(\s*f[\"\']", r"execute\s*\([^)]*%", r"execute\s*\([^)]*\.format\("), extensions=(".py",)),
    Check("FLASK-SSTI-001", "Server-Side Template Injection", "critical", "medium", "CWE-94", "A03", (r"render_template_string\s*\(", r"Template\s*\(\s*[^)]*request\."), extensions=(".py",)),
    Check("FLASK-REDIRECT-001", "Open Redirect", "medium", "medium", "CWE-601", "A01", (r"redirect\s*\(\s*request\.args", r"redirect\s*\(\s*request\.form"), extensions=(".py",)),
)
REACT = (
    Check("REACT-XSS-001", "Dangerous HTML Injection", "medium", "medium", "CWE-79", "A03", (r"dangerouslySetInnerHTML\s*=\s*\{\s*\{", r"dangerouslySetInnerHTML=\{"), around=(100, 100), raised="high", raised_by=("props", "state")),
    Check("REACT-XSS-002", "Unsafe href Attribute", "high", "medium", "CWE-79", "A03", (r"href\s*=\s*\{[^}]*\+", r"href\s*=\s*\{`[^`]*\$\{", r"href\s*=\s*[\"\']javascript:")),
    Check("REACT-EVAL-001", "Code Execution via eval", "high", "medium", "CWE-94", "A03", (r"\beval\s*\(", r"new\s+Function\s*\(", r"setTimeout\s*\([^)]*[\"\']", r"setInterval\s*\([^)]*[\"\']")),
    Check("REACT-LINK-001", "Unsafe External Link", "low", "high", "CWE-1022", "A05", (r"target\s*=\s*[\"\']_blank[\"\']",), around=(100, 100), near=("noopener", "noreferrer")),
    Check("REACT-STORAGE-001", "Sensitive Data in Browser Storage", "medium", "medium", "CWE-922", "A07", (
        r"localStorage\.setItem\s*\([^)]*(?:token|password|secret|key)", r"sessionStorage\.setItem\s*\([^)]*(?:token|password|secret|key)"), "i"),
)
VUE = (Check("VUE-XSS-001", "v-html XSS Risk", "high", "medium", "CWE-79", "A03", (r"v-html\s*=",)),)
ANGULAR = (Check("ANGULAR-XSS-001", "Security Bypass", "high", "high", "CWE-79", "A03", (r"bypassSecurityTrust\w+",)),)
FRAMEWORKS = {
    "django": ((".py", ".html"), DJANGO), "flask": ((".py", ".html"), FLASK), "react": ((".js", ".jsx", ".ts", ".tsx"), REACT), "vue": ((".vue", ".js", ".ts"), VUE), "angular": ((".ts", ".html"), ANGULAR),
    "express": ((".js", ".ts"), ()), "rails": ((".rb", ".erb"), ()), "aspnet": ((".cs", ".cshtml"), ()), "gin": ((".go",), ()), "laravel": ((".php",), ()),
    "graphql": ((".graphql", ".gql", ".js", ".ts"), ()), "grpc": ((".proto",), ()), "android": ((".kt", ".java", ".xml"), ()), "ios": ((".swift", ".m", ".h"), ()),
}
