import pytest

from lodestone.operators import callgraph, checks, context, enrich, findings, mybatis, onepass, patterns, priority, spring, taint
from lodestone.operators.check_tables import FRAMEWORKS, LANGUAGES
from lodestone.plans import reports
from lodestone.plans.scan import Scan
from lodestone.sources import corpus, files, rules

WEB = "src/main/java/shop/WebSecurity.java"
ORDERS = "src/main/java/shop/OrderController.java"


@pytest.fixture(scope="module")
def source(spark):
    return corpus.files(spark).cache()


@pytest.fixture(scope="module")
def table(spark):
    return rules.from_rows(spark, corpus.RULES).cache()


def keys(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or ("rule_id", "file_path", "line_number"))).collect())


def test_rules_match_as_python_does(source, table):
    native = patterns.match_rules(source, table)
    expected = keys(onepass.scan(source, table.filter("enabled"), ("rules",)), "rule_id", "file_path", "line_number", "pattern_idx", "match_no", "matched_pattern", "snippet", "engine")
    assert keys(native, "rule_id", "file_path", "line_number", "pattern_idx", "match_no", "matched_pattern", "snippet", "engine") == expected
    assert keys(patterns.match_rules(source, table, exact=True)) == keys(native)
    assert ("CMD-100", "src/main/java/shop/Files.java", 14) in keys(native)
    assert ("CMD-100", "src/main/java/shop/Files.java", 7) not in keys(native)  # suppressed on its line
    assert ("CFG-100", "src/main/resources/application.properties", 2) in keys(native) and not any(k[0] == "CFG-101" for k in keys(native))
    assert ("SQLI-100", "web/app/views.py", 7) in keys(native) and ("SQLI-100", "web/app/views.py", 5) not in keys(native)  # inside a long string


@pytest.mark.parametrize("language", ["php", "rust", "swift"])
def test_native_checks_equal_one_pass(source, table, language):
    one = onepass.scan(source, table, ("languages",)).filter(f"engine = 'language:{language}'")
    columns = ("rule_id", "file_path", "line_number", "severity", "matched_pattern", "snippet")
    assert keys(checks.language_checks(source, language), *columns) == keys(one, *columns) != []


def test_native_framework_checks_equal_one_pass(source, table):
    one = onepass.scan(source, table, ("frameworks",)).filter("engine = 'framework:react'")
    assert keys(checks.framework_checks(source, "react")) == keys(one) != []


def test_every_table_finds_something(source, table):
    found = {r.engine for r in onepass.scan(source, table, ("languages", "frameworks", "iac")).select("engine").distinct().collect()}
    assert {f"language:{x}" for x in LANGUAGES} <= found and {f"framework:{x}" for x, (_, t) in FRAMEWORKS.items() if t} <= found
    assert {"iac:terraform", "iac:kubernetes", "iac:dockerfile", "iac:cloudformation"} <= found


def test_spring(source):
    got = keys(spring.findings(source), "rule_id", "line_number", "severity")
    for expected in (("SPRING-SEC-001", 4, "high"), ("SPRING-SEC-002", 5, "medium"), ("SPRING-SEC-003", 6, "critical"), ("SPRING-SEC-004", 7, "medium"), ("SPRING-VALID-001", 10, "medium"), ("SPRING-XFILE-001", 10, "high"),
                     ("SPRING-JPA-001", 4, "critical"), ("SPRING-JPA-001", 7, "critical"), ("SPRING-JPA-002", 7, "critical"), ("SPRING-INPUT-001", 11, "low"), ("SPRING-CFG-001", 1, "high")):
        assert expected in got
    assert len(got) == 13
    assert keys(spring.endpoints(source), "http_method", "url", "line_number", "has_authentication") == [("DELETE", "/orders/{id}", 18, True), ("GET", "/orders/{id}", 7, False), ("POST", "/orders", 10, False)]


def test_mybatis(source):
    got = keys(mybatis.findings(source), "rule_id", "line_number", "severity", "confidence")
    assert ("MYBATIS-001", 7, "critical", "high") in got and ("MYBATIS-004", 11, "critical", "high") in got and ("MYBATIS-002", 14, "high", "medium") in got and ("MYBATIS-003", 14, "high", "medium") in got
    assert keys(mybatis.statements(source), "statement_id", "line_number") == [("byId", 4), ("like", 11), ("many", 14), ("open", 19), ("sorted", 7)]
    assert tuple(mybatis.statistics(source).first()) == (1, 5, 4, 80.0)


def test_context(source, table):
    flags = {r.path: r for r in context.file_context(source).collect()}
    assert flags["src/test/java/shop/FilesTest.java"].is_test and not flags[WEB].is_test
    kept = keys(context.with_context(patterns.match_rules(source, table), source))
    assert not any(k[1].startswith("vendor/") for k in kept if "/vendor/" in "/" + k[1] and "/lib/" in k[1])


def test_graph_and_taint(source):
    found = callgraph.methods(source)
    sites = callgraph.calls(source, found)
    links = keys(callgraph.resolved(sites, found), "caller_uid", "callee_uid")
    assert ("src/main/java/shop/Files.java:Files.open:4", "src/main/java/shop/Files.java:helper.run:12") in links
    assert ("DATAFLOW-COMMAND_EXEC", "src/main/java/shop/Files.java", 7) in keys(taint.findings(source))


def test_walk_visits_once(spark):
    graph = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "caller_uid string, callee_uid string")
    starts = spark.createDataFrame([("a",)], "s string")
    assert keys(callgraph.reached(graph, starts), "node", "depth") == [("a", 0), ("b", 1), ("c", 1)]
    assert keys(callgraph.reached(graph, starts, reverse=True), "node", "depth") == [("a", 0), ("b", 2), ("c", 1)]


def test_whole_scan(source, table):
    found = Scan().run(source, table).cache()
    assert found.count() == len(set(keys(found)))
    assert [r.severity for r in findings.ordered(found).select("severity").collect()] == sorted([r.severity for r in found.select("severity").collect()], key=["critical", "high", "medium", "low", "info"].index)
    assert findings.exit_code(found).first().exit_code == 3
    assert {r.severity: r.n for r in findings.summary(found).collect()}["info"] == 0
    assert [r.finding_id for r in reports.csv_table(found).orderBy("finding_id").limit(2).collect()] == ["F0001", "F0002"]
    text = reports.sarif(found, "tool", "1")
    assert '"version": "2.1.0"' in text and "CMD-100" in text
    assert "more" not in reports.html(found, "t") and "CRITICAL" in reports.console(found, 2)


def test_priorities(spark):
    rows = [("SQLI-001", "critical", "A03", "CWE-89"), ("XSS-001", "high", "A03", "CWE-79"), ("LOG-001", "low", "A09", "CWE-532")]
    found = findings.shaped(spark.createDataFrame(rows, "rule_id string, severity string, owasp string, cwe string"))
    got = {r.rule_id: (r.priority_score, r.risk_level) for r in priority.prioritized(found).collect()}
    assert got == {"SQLI-001": (141.0, "CRITICAL"), "XSS-001": (84.6, "CRITICAL"), "LOG-001": (16.0, "INFO")}
    assert priority.within_budget(found, 2 * priority.unit_cost("full"), "rule_id").count() == 2


def test_enrichment_uses_the_cache(spark, source):
    asked = enrich.prompts(spring.findings(source).filter("rule_id = 'SPRING-SEC-001'"), source).cache()
    key = asked.first().cache_key
    cache = spark.createDataFrame([(key, '{"is_false_positive": true, "confidence": "high"}')], "cache_key string, reply string")
    row = enrich.enhanced(enrich.answered(asked, enrich.stub_provider, cache)).first()
    assert row.cached and row.adjusted_severity == "info" and not row.parse_error


def test_selection(spark, tmp_path):
    for name, text in {"a.py": "x = 1", "b.txt": "no", "node_modules/c.js": "no", "sub/Dockerfile": "FROM a", "sub/latin.py": None}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"caf\xe9\r\nz" if text is None else text.encode())
    got = {r.path.removeprefix(str(tmp_path)): r.content for r in files.from_tree(spark, str(tmp_path)).collect()}
    assert got == {"/a.py": "x = 1", "/sub/Dockerfile": "FROM a", "/sub/latin.py": "café\nz"}


def test_rules_from_yaml(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("metadata: {category: A03}\nrules:\n- {id: R-1, name: one, severity: odd, detection: {patterns: [x, {pattern: y, missing: z}]}}\n- {name: no id}\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    row = rules.from_yaml(spark, str(tmp_path)).first()
    assert (row.rule_id, row.severity, row.owasp, len(row.patterns)) == ("R-1", "medium", "A03", 2)


def test_empty_inputs(spark, source, table):
    none = source.limit(0)
    assert Scan().run(none, table).count() == 0
    assert findings.summary(findings.shaped(none.selectExpr("path AS file_path"))).count() == 5
