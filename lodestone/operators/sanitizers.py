"""Functions that make tainted values harmless, and those that only pass them on."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SQL, COMMAND, FILE, SSRF, XSS, DESERIALIZATION, LDAP, XPATH, LOG = "sql_query", "command_exec", "file_access", "ssrf", "xss", "deserialization", "ldap_query", "xpath_query", "log_output"
SINKS = (SQL, COMMAND, FILE, SSRF, XSS, DESERIALIZATION, LDAP, XPATH, LOG)


@dataclass(frozen=True)
class Sanitizer:
    """A function, the part of a class name it needs, the packages it may be in (a pattern), what it cleans for, and which argument."""

    method: str
    owner: str | None
    cleans: tuple[str, ...]
    package: str | None = None
    argument: int = 0
    returns: bool = True

    def matches(self, method: str, owner: str | None = None, package: str | None = None) -> bool:
        if method != self.method or (self.owner and self.owner not in (owner or "")):
            return False
        return not (self.package and package) or re.match(self.package, package) is not None


# Method, part of the class name, cleaned for, package; by language, in the order in which the first that fits is taken.
_ESAPI, _ENCODER, _SPRING, _TEXT, _LANG, _JDBC = r"org\.owasp\.esapi", r"org\.owasp\.encoder", r"org\.springframework\.web\.util", r"org\.apache\.commons\.text", r"org\.apache\.commons\.lang", r"java\.sql"
_NUMBER = (SQL, COMMAND, FILE)
JAVA = (
    Sanitizer("encodeForSQL", "ESAPI", (SQL,), _ESAPI),
    Sanitizer("encodeForHTML", "ESAPI", (XSS,), _ESAPI),
    Sanitizer("encodeForHTMLAttribute", "ESAPI", (XSS,), _ESAPI),
    Sanitizer("encodeForJavaScript", "ESAPI", (XSS,), _ESAPI),
    Sanitizer("encodeForLDAP", "ESAPI", (LDAP,), _ESAPI),
    Sanitizer("encodeForXPath", "ESAPI", (XPATH,), _ESAPI),
    Sanitizer("encodeForOS", "ESAPI", (COMMAND,), _ESAPI),
    Sanitizer("encodeForURL", "ESAPI", (SSRF,), _ESAPI),
    Sanitizer("forHtml", "Encode", (XSS,), _ENCODER),
    Sanitizer("forHtmlContent", "Encode", (XSS,), _ENCODER),
    Sanitizer("forHtmlAttribute", "Encode", (XSS,), _ENCODER),
    Sanitizer("forJavaScript", "Encode", (XSS,), _ENCODER),
    Sanitizer("forJavaScriptSource", "Encode", (XSS,), _ENCODER),
    Sanitizer("forUri", "Encode", (SSRF, XSS), _ENCODER),
    Sanitizer("forUriComponent", "Encode", (SSRF, XSS), _ENCODER),
    Sanitizer("htmlEscape", "HtmlUtils", (XSS,), _SPRING),
    Sanitizer("javaScriptEscape", "JavaScriptUtils", (XSS,), _SPRING),
    Sanitizer("escapeHtml4", "StringEscapeUtils", (XSS,), _TEXT),
    Sanitizer("escapeHtml3", "StringEscapeUtils", (XSS,), _TEXT),
    Sanitizer("escapeXml10", "StringEscapeUtils", (XSS, XPATH), _TEXT),
    Sanitizer("escapeEcmaScript", "StringEscapeUtils", (XSS,), _TEXT),
    Sanitizer("escapeHtml", "StringEscapeUtils", (XSS,), _LANG),
    Sanitizer("escapeSql", "StringEscapeUtils", (SQL,), _LANG),
    Sanitizer("setString", "PreparedStatement", (SQL,), _JDBC, 1),
    Sanitizer("setInt", "PreparedStatement", (SQL,), _JDBC, 1),
    Sanitizer("setLong", "PreparedStatement", (SQL,), _JDBC, 1),
    Sanitizer("setObject", "PreparedStatement", (SQL,), _JDBC, 1),
    Sanitizer("setBoolean", "PreparedStatement", (SQL,), _JDBC, 1),
    Sanitizer("parseInt", "Integer", _NUMBER, r"java\.lang"),
    Sanitizer("parseLong", "Long", _NUMBER, r"java\.lang"),
    Sanitizer("parseDouble", "Double", (SQL, COMMAND), r"java\.lang"),
    Sanitizer("valueOf", "Integer", _NUMBER, r"java\.lang"),
    Sanitizer("valueOf", "Long", _NUMBER, r"java\.lang"),
    Sanitizer("encode", "URLEncoder", (SSRF, XSS), r"java\.net"),
    Sanitizer("htmlEscaper", "HtmlEscapers", (XSS,), r"com\.google\.common\.html", returns=False),
    Sanitizer("escape", "CharEscaper", (XSS,), r"com\.google\.common\.escape"),
    Sanitizer("clean", "Jsoup", (XSS,), r"org\.jsoup"),
    Sanitizer("getCanonicalPath", "File", (FILE,), r"java\.io"),
    Sanitizer("normalize", "Path", (FILE,), r"java\.nio\.file"),
    Sanitizer("toRealPath", "Path", (FILE,), r"java\.nio\.file"),
)
PYTHON = (
    Sanitizer("escape", "html", (XSS,)),
    Sanitizer("quote", "shlex", (COMMAND,)),
    Sanitizer("quote", "urllib.parse", (SSRF, XSS)),
    Sanitizer("quote_plus", "urllib.parse", (SSRF, XSS)),
    Sanitizer("escape", "django.utils.html", (XSS,)),
    Sanitizer("mark_safe", "django.utils.safestring", ()),
    Sanitizer("format_html", "django.utils.html", (XSS,)),
    Sanitizer("clean", "bleach", (XSS,)),
    Sanitizer("linkify", "bleach", (XSS,)),
    Sanitizer("escape", "markupsafe", (XSS,)),
)
JAVASCRIPT = (
    Sanitizer("escape", "validator", (XSS,)),
    Sanitizer("sanitize", "DOMPurify", (XSS,)),
    Sanitizer("inHTMLData", "xssFilters", (XSS,)),
    Sanitizer("inHTMLComment", "xssFilters", (XSS,)),
    Sanitizer("encode", "he", (XSS,)),
    Sanitizer("normalize", "path", (FILE,)),
    Sanitizer("resolve", "path", (FILE,)),
    Sanitizer("sanitizeHtml", None, (XSS,)),
    Sanitizer("escapeHtml", None, (XSS,)),
    Sanitizer("escape", "_", (XSS,)),
    Sanitizer("encodeURIComponent", None, (XSS, SSRF)),
    Sanitizer("encodeURI", None, (SSRF,)),
)
GO = (
    Sanitizer("HTMLEscapeString", "html", (XSS,)),
    Sanitizer("HTMLEscaper", "html", (XSS,)),
    Sanitizer("EscapeString", "html", (XSS,)),
    Sanitizer("QueryEscape", "url", (XSS, SSRF)),
    Sanitizer("PathEscape", "url", (FILE, SSRF)),
    Sanitizer("Clean", "filepath", (FILE,)),
    Sanitizer("Abs", "filepath", (FILE,)),
    Sanitizer("Prepare", "DB", (SQL,)),
    Sanitizer("QueryRow", "DB", (SQL,), argument=1),
    Sanitizer("Atoi", "strconv", (SQL, COMMAND)),
    Sanitizer("ParseInt", "strconv", (SQL, COMMAND)),
    Sanitizer("Sanitize", "Policy", (XSS,)),
    Sanitizer("SanitizeBytes", "Policy", (XSS,)),
)
_ANTI_XSS = r"Microsoft\.Security\.Application"
CSHARP = (
    Sanitizer("HtmlEncode", "HttpUtility", (XSS,)),
    Sanitizer("HtmlAttributeEncode", "HttpUtility", (XSS,)),
    Sanitizer("UrlEncode", "HttpUtility", (SSRF, XSS)),
    Sanitizer("JavaScriptStringEncode", "HttpUtility", (XSS,)),
    Sanitizer("HtmlEncode", "WebUtility", (XSS,)),
    Sanitizer("UrlEncode", "WebUtility", (SSRF, XSS)),
    Sanitizer("Escape", "SecurityElement", (XSS,)),
    Sanitizer("HtmlEncode", "Encoder", (XSS,), _ANTI_XSS),
    Sanitizer("JavaScriptEncode", "Encoder", (XSS,), _ANTI_XSS),
    Sanitizer("UrlEncode", "Encoder", (SSRF,), _ANTI_XSS),
    Sanitizer("LdapEncode", "Encoder", (LDAP,), _ANTI_XSS),
    Sanitizer("AddWithValue", "SqlParameterCollection", (SQL,)),
    Sanitizer("Add", "SqlParameterCollection", (SQL,)),
    Sanitizer("GetFullPath", "Path", (FILE,)),
    Sanitizer("Parse", "Int32", (SQL, COMMAND)),
    Sanitizer("TryParse", "Int32", (SQL, COMMAND)),
)
RUBY = (
    Sanitizer("html_escape", "ERB::Util", (XSS,)),
    Sanitizer("h", None, (XSS,)),
    Sanitizer("escapeHTML", "CGI", (XSS,)),
    Sanitizer("escape", "CGI", (SSRF, XSS)),
    Sanitizer("escape_html", "Rack::Utils", (XSS,)),
    Sanitizer("sanitize", "ActionView", (XSS,)),
    Sanitizer("strip_tags", "ActionView", (XSS,)),
    Sanitizer("escape", "Shellwords", (COMMAND,)),
    Sanitizer("shellescape", "String", (COMMAND,)),
    Sanitizer("sanitize_sql", "ActiveRecord", (SQL,)),
    Sanitizer("sanitize_sql_array", "ActiveRecord", (SQL,)),
    Sanitizer("realpath", "File", (FILE,)),
    Sanitizer("expand_path", "File", (FILE,)),
    Sanitizer("to_i", "String", (SQL, COMMAND)),
)
RUST = (
    Sanitizer("encode_text", "html_escape", (XSS,)),
    Sanitizer("encode_safe", "html_escape", (XSS,)),
    Sanitizer("escape", "askama", (XSS,)),
    Sanitizer("clean", "ammonia", (XSS,)),
    Sanitizer("encode", "urlencoding", (SSRF, XSS)),
    Sanitizer("canonicalize", "Path", (FILE,)),
    Sanitizer("bind", "Query", (SQL,)),
    Sanitizer("escape", "shell_escape", (COMMAND,)),
)
PHP = (
    Sanitizer("htmlspecialchars", None, (XSS,)),
    Sanitizer("htmlentities", None, (XSS,)),
    Sanitizer("strip_tags", None, (XSS,)),
    Sanitizer("escapeshellarg", None, (COMMAND,)),
    Sanitizer("escapeshellcmd", None, (COMMAND,)),
    Sanitizer("addslashes", None, (SQL,)),
    Sanitizer("real_escape_string", "mysqli", (SQL,)),
    Sanitizer("mysqli_real_escape_string", None, (SQL,)),
    Sanitizer("prepare", "PDO", (SQL,)),
    Sanitizer("bindParam", "PDOStatement", (SQL,)),
    Sanitizer("bindValue", "PDOStatement", (SQL,)),
    Sanitizer("urlencode", None, (SSRF, XSS)),
    Sanitizer("rawurlencode", None, (SSRF, XSS)),
    Sanitizer("realpath", None, (FILE,)),
    Sanitizer("basename", None, (FILE,)),
    Sanitizer("filter_var", None, (XSS, SQL)),
    Sanitizer("filter_input", None, (XSS, SQL)),
    Sanitizer("intval", None, (SQL, COMMAND)),
    Sanitizer("floatval", None, (SQL,)),
    Sanitizer("purify", "HTMLPurifier", (XSS,)),
)
BUILT_IN = (*JAVA, *PYTHON, *JAVASCRIPT, *GO, *CSHARP, *RUBY, *RUST, *PHP)

# Methods that change a value and leave its taint.
PRESERVING = frozenset(
    """
    trim strip stripLeading stripTrailing lstrip rstrip toLowerCase toUpperCase lower upper capitalize title
    substring subSequence slice substr replace replaceAll replaceFirst gsub sub split join rsplit
    concat append prepend push unshift toString valueOf str __str__ format sprintf printf
    chars bytes toCharArray encode decode getBytes
    map filter flatMap reduce fold sorted sort distinct uniq limit skip take drop collect toList toArray list tuple
    each forEach for_each first last reverse reversed zip enumerate iter
    builder build add set with and
    get orElse orElseGet unwrap unwrap_or expect getOrDefault getOrElse
    chomp chop squeeze swapcase lines each_char each_line
    String Bytes Runes
    as_str as_bytes into_string to_string to_owned split_whitespace
    ltrim rtrim strtolower strtoupper str_replace preg_replace explode implode
    """.split()
)


class Registry:
    """Sanitizers by method name; more can be added to the built-in ones, and any taken out."""

    def __init__(self, more: Iterable[Sanitizer] = (), built_in: Iterable[Sanitizer] = BUILT_IN):
        self._of: dict[str, list[Sanitizer]] = defaultdict(list)
        for one in (*built_in, *more):
            self.add(one)

    def add(self, one: Sanitizer) -> None:
        self._of[one.method].append(one)

    def remove(self, method: str, owner: str | None = None) -> None:
        """Take out a method's sanitizers, or those of one class name."""
        left = [s for s in self._of.pop(method, []) if owner and s.owner != owner]
        if left:
            self._of[method] = left

    def find(self, method: str, owner: str | None = None, package: str | None = None) -> Sanitizer | None:
        return next((s for s in self._of.get(method, ()) if s.matches(method, owner, package)), None)

    def __contains__(self, method: str) -> bool:
        return method in self._of

    def for_sink(self, sink: str) -> list[Sanitizer]:
        return [s for of in self._of.values() for s in of if sink in s.cleans]

    def table(self, spark: SparkSession) -> DataFrame:
        """(priority, method, owner, package, cleans, argument, returns): the dimension for joins."""
        rows = [(k, s.method, s.owner, s.package, list(s.cleans), s.argument, s.returns) for k, s in enumerate(s for of in self._of.values() for s in of)]
        return spark.createDataFrame(rows, "priority int, method string, owner string, package string, cleans array<string>, argument int, returns boolean")


def looked_up(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """calls (with method, owner, package) and the first sanitizer that fits each: equal method, the owner holds the name part, the package matches; null without one.

    Candidates are gathered by method first (a dimension of some hundred rows),
    so the calls join once and are not shuffled.
    """
    candidates = registry.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("priority", "owner", "package", "cleans", "argument"))).alias("__of"))
    joined = calls.join(F.broadcast(candidates), "method", "left")

    def fits(s: Column) -> Column:
        owner = s["owner"].isNull() | F.coalesce(F.col("owner").contains(s["owner"]), F.lit(False))
        package = s["package"].isNull() | F.col("package").isNull() | F.call_function("regexp_like", F.col("package"), F.concat(F.lit("^(?:"), s["package"], F.lit(")")))
        return owner & package

    first = F.try_element_at(F.filter("__of", fits), F.lit(1))
    return joined.select(*calls.columns, first.isNotNull().alias("is_sanitizer"), first["owner"].alias("sanitizer_owner"), first["cleans"].alias("cleans"), first["argument"].alias("argument"))
