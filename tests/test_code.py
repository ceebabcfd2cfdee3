import os
import subprocess
import time
import zipfile

import pandas as pd
import pytest

from lodestone.functions import scriptcode
from lodestone.functions.javacode import Java, blanked, parts
from lodestone.functions.regex import java, matches
from lodestone.functions.text import valid_secret
from lodestone.operators import astcheck, callgraph, casefile, deepflow, enrich, findings, multilang, onepass, registry, sanitizers, spring, taint
from lodestone.plans import hooks, reports, spreadsheet
from lodestone.plans.profile import Profile
from lodestone.plans.scan import Scan, dataflow
from lodestone.sources import corpus, files, rules

CONTROLLER = "app/web/ReportController.java"


@pytest.fixture(scope="module")
def code(spark):
    return corpus.files(spark, corpus.CODE).cache()


def keys(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or ("rule_id", "file_path", "line_number"))).collect())


def test_java_reader():
    source = Java(
        'class A<T> extends B implements C, D<E> {\n  String s = "class X { (";  // }\n  Runnable r = () -> { go("x"); };\n  A(int a) { this.s = f(a); }\n'
        "  @Get(\"/\") public <T> List<T> get(@Q(\"q\") String q, Map<K, V> m, int... n) throws X {\n    int a = 1, b = req.getParameter(\"q\");\n    new Foo(q).bar(baz(1), \"a,b\").qux();\n    x = y[f(1)].g(q);\n  }\n  abstract void none();\n  enum Kind { ONE; int k() { return 1; } }\n}\n"
    )
    one, kind = source.types()
    assert (one.name, one.extends, one.implements, source.line_of(one.end)) == ("A", "B", ["C", "D"], 12)
    assert [(m.name, m.parameters, m.return_type, source.line_of(m.start), source.line_of(m.end), m.abstract) for m in one.methods] == [("get", ['@Q("q") String q', "Map<K, V> m"], "List<T>", 5, 9, False), ("none", [], "void", 10, 10, True)]
    assert kind.kind == "enum" and [t.name for t in source.classes()] == ["A"]
    assert [(c.name, c.text) for c in source.calls()] == [
        ("go", 'go("x")'), ("f", "f(a)"), ("getParameter", 'req.getParameter("q")'), ("qux", 'new Foo(q).bar(baz(1), "a,b").qux()'), ("bar", 'new Foo(q).bar(baz(1), "a,b")'), ("baz", "baz(1)"), ("g", "y[f(1)].g(q)"), ("f", "f(1)"),
    ]
    assert ("b", 'req.getParameter("q")') in source.assignments() and ("x", "y[f(1)].g(q)") in source.assignments()
    assert blanked('a /* b\n( */ "c(" // )') == 'a     \n     "__"     ' and parts("a, f(b, c), [d, e]") == ["a", "f(b, c)", "[d, e]"]
    assert Java("").types() == [] and Java("}}} class {").types() == [] and Java('"open').calls() == []


def test_script_readers():
    text = "function f(a) { return g(a, `x ${b(1)}`); }\nclass C { m(x) { new Foo(x).go('(').z?.(2); } }\nawait axios.get(url + '/', {a: [1, 2]})\n"
    assert [(n, line, a) for n, line, a, _ in scriptcode.script_calls(text)] == [("g", 1, ["a", "`x ${b(1)}`"]), (None, 2, ["2"]), (None, 2, ["'('"]), ("axios.get", 3, ["url + '/'", "{a: [1, 2]}"])]
    assert [(n, line, a) for n, line, a, _ in scriptcode.python_calls("x = f(a, k=g(1), *b)\n'a'.join(c)\n")] == [("f", 1, ["a", "*b", "k=g(1)"]), ("g", 1, ["1"]), (None, 2, ["c"])]
    assert list(scriptcode.python_calls("def (")) == [] and [x[0] for x in scriptcode.python_functions("async def f(a, *b, c=1, **d): pass")] == ["f"]
    assert scriptcode.in_string('a = "b c"', 6, "java") and not scriptcode.in_string('a = "b c"', 4, "java") and scriptcode.in_string("x = `a`", 5, "javascript") and not scriptcode.in_string("x = `a`", 5, "go")


def statement(body, *parameters):
    flow = deepflow.Flow(deepflow.Body(list(parameters), body, 1), "F", 1, sanitizers.Registry())
    return sorted({(sink, line) for sink, _, line in flow.run().reached})


def test_taint_within_a_method():
    given = "@RequestParam String id"
    assert statement('String q = "a " + id;\ns.executeQuery(q);', given) == [("sql_query", 2)]
    assert statement("q = id;\nq = q + 1;\ns.executeQuery(q);", given) == []  # the right side is read as the new version
    assert statement('s.executeQuery("a" + id + "b");', given) == []  # read as one literal
    assert statement("s.executeQuery(id.trim());", given) == []  # the arguments end at the first closing bracket
    assert statement("String t = id.trim();\ns.executeQuery(t);\nlogger.info(t);", given) == [("log_output", 3), ("sql_query", 2)]
    assert statement("String t = escapeHtml(id);\nout.println(t);\ns.execute(t);", given) == [("sql_query", 3)]
    assert statement("Object o = new Foo(id);\nr.exec(o);", given) == [("command_exec", 2)]
    assert statement("s.executeQuery(id);", "String id") == []  # no source, nothing to follow
    assert statement("f.readAllBytes(id);", given) == []  # a source is no sink
    registry_ = sanitizers.Registry([sanitizers.Sanitizer("mine", None, ("sql_query",))])
    body = deepflow.Body([given], "String t = mine(id);\ns.execute(t);", 1)
    assert deepflow.Flow(body, "F", 1, registry_).run().reached == []


def test_lattice_values_join():
    a = deepflow.Value(3, frozenset(("x",)), ("p",), frozenset(("xss", "ssrf")))
    b = deepflow.Value(2, frozenset(("y",)), ("p", "q"), frozenset(("xss",)))
    assert a.join(b) == b.join(a) == deepflow.Value(3, frozenset("xy"), ("p", "q"), frozenset(("xss",)))
    assert a.join(a) == a and a.join(deepflow.Value(0)) == a and not a.reaches("xss") and a.reaches("sql_query")
    assert a.cleaned_for(sanitizers.SINKS).level == deepflow.PARTLY


def test_deep_findings_come_first(spark, code):
    found = keys(dataflow(code.unionByName(corpus.files(spark))), "rule_id", "file_path", "line_number", "severity")
    assert found == [("DATAFLOW-SQL-QUERY", CONTROLLER, 10, "critical")]
    assert {r[0] for r in keys(dataflow(corpus.files(spark)))} == {"DATAFLOW-COMMAND_EXEC", "DATAFLOW-FILE_ACCESS"}


def test_basic_taint_grades(spark):
    rows = taint.findings(corpus.files(spark)).select("rule_id", "rule_name", "severity", "tags", "description", "remediation").distinct().collect()
    by = {r.rule_id: r for r in rows}
    assert by["DATAFLOW-COMMAND_EXEC"].severity == "high" and by["DATAFLOW-FILE_ACCESS"].severity == "medium"
    assert by["DATAFLOW-FILE_ACCESS"].rule_name == "Path Traversal via http_parameter" and by["DATAFLOW-FILE_ACCESS"].tags == ["dataflow", "file_access", "http_parameter"]
    assert "flows to file_access sink" in by["DATAFLOW-FILE_ACCESS"].description and "http_parameter" in by["DATAFLOW-FILE_ACCESS"].remediation


def test_one_bad_file_does_not_end_a_scan(spark, monkeypatch):
    source = files.from_table(spark.createDataFrame([("a.java", "class A { void f() { x.exec(\"a\" + b); } }"), ("b.java", "class " * 50 + "{" * 200), ("c.java", None)], "path string, content string"))
    assert astcheck.java_findings(source).count() == 1
    assert deepflow.findings(source).count() == 0


def test_a_flow_that_raises_costs_its_own_file(monkeypatch):
    of = {p: c for p, c in (corpus.FILES | corpus.CODE).items() if p.endswith(".java")}
    found = lambda: [r for p, c in of.items() for r in deepflow._reached(p, c, sanitizers.Registry())]
    assert found()
    monkeypatch.setattr(deepflow.Flow, "run", lambda self: 1 / 0)
    assert found() == []


def test_sanitizers():
    known = sanitizers.Registry()
    assert known.find("encodeForHTML", "org.owasp.esapi.ESAPI").cleans == ("xss",) and known.find("encodeForHTML") is None
    assert known.find("valueOf", "java.lang.Long").owner == "Long" and known.find("forUri", "Encode", "com.other") is None
    assert {s.method for s in known.for_sink("ldap_query")} == {"encodeForLDAP", "LdapEncode"}
    known.add(sanitizers.Sanitizer("mine", None, ("sql_query",)))
    known.remove("valueOf", "Integer")
    known.remove("quote")
    assert "mine" in known and "quote" not in known and [s.owner for s in known._of["valueOf"]] == ["Long"]


def test_tables_of_languages():
    assert multilang.sources("CS")["Read"] == "user_input" and multilang.sinks("kt")["exec"] == "command_exec" and multilang.sinks("php")["fopen"] == "ssrf"
    assert multilang.cleans("go", "PathEscape", "ssrf") and not multilang.cleans("go", "PathEscape", "xss") and multilang.annotations("csharp")["[FromBody]"] == "http_body"
    assert multilang.sources("cobol") == {} and multilang.language_of("RB") == "ruby"


def test_secrets_are_validated_in_the_scan(spark):
    weak, strong = 'password = "aaaaaaaaaaaaaaaaaaaaaaaa"', 'password = "q8Zr2LmX0vTn7KsB4yHdW1cP"'
    source = files.from_table(spark.createDataFrame([("a.py", weak), ("b.py", strong), ("c.py", 'password = "aB1aB1aB1aB1zz9"')], "path string, content string"))
    table = rules.from_rows(spark, [{"id": "S-1", "name": "s", "severity": "high", "tags": ["secret"], "languages": ["python"], "detection": {"patterns": [r'password = "[^"]+"']}}])
    assert [r[1] for r in keys(onepass.scan(source, table, ("rules",)))] == ["b.py", "c.py"]
    assert [r.v for r in source.orderBy("path").select(valid_secret(source["content"]).alias("v")).collect()] == [onepass.valid_secret(x) for x in (weak, strong, 'password = "aB1aB1aB1aB1zz9"')]


def test_relative_roots(spark, tmp_path, monkeypatch):
    (tmp_path / "build/proj/src").mkdir(parents=True)
    (tmp_path / "build/proj/src/a.py").write_text("x")
    (tmp_path / "build/proj/build").mkdir()
    (tmp_path / "build/proj/build/b.py").write_text("x")
    monkeypatch.chdir(tmp_path / "build")
    for root in ("proj", "./proj/", str(tmp_path / "build/proj"), f"file://{tmp_path}/build/proj"):
        assert [os.path.basename(r.path) for r in files.from_tree(spark, root).collect()] == ["a.py"]


def test_work_is_linear_in_matches_and_lines(spark):
    """A file of 4 MB with 100,000 matches and one with 60,000 lines; quadratic work would not end here."""
    begun = time.time()
    text = 'token = "abcdefghijklmnopq"\nx\n' * 100_000
    table = spark.createDataFrame([("a.py", text)], "path string, content string")
    found = table.selectExpr("content").select(matches(table["content"], java(r'token = "[^"]+"')).alias("m"))
    assert [tuple(r) for r in found.selectExpr("size(m)", "m[99999].line", "m[99999].matched").collect()] == [(100_000, 199_999, 'token = "abcdefghijklmnopq"')]
    rule = rules.from_rows(spark, [{"id": "T-1", "name": "t", "severity": "low", "detection": {"patterns": [r"token"]}}])
    assert onepass.scan(files.from_table(table), rule, ("rules",)).count() == 100_000
    lines = "@RestController\nclass A {\n" + "  int f(int a) { return b(a); }\n" * 60_000 + "  @GetMapping(\"/x\")\n  public String g(@RequestBody String q) { s.executeQuery(q); }\n}\n"
    source = files.from_table(spark.createDataFrame([("src/A.java", lines)], "path string, content string"))
    assert [r.line_number for r in spring.endpoints(source).collect()] == [60_003]
    assert [r.line for r in taint.sinks(source).filter("sink_type = 'sql_query'").collect()] == [60_004]
    assert [r[2] for r in keys(deepflow.findings(source))] == []  # the header line holds the call
    assert spring.findings(source).count() >= 1
    assert time.time() - begun < 120


def test_spring_rules_need_a_project(spark):
    plain = files.from_table(spark.createDataFrame([("x/settings.yml", "debug: true\n")], "path string, content string"))
    assert spring.findings(plain).count() == 1 and spring.project_findings(plain).count() == 0
    named = files.from_table(spark.createDataFrame([("x/settings.yml", "debug: true\n"), ("x/AppConfig.java", "class AppConfig {}")], "path string, content string"))
    assert spring.project_findings(named).count() == 1


def test_contexts(spark, code):
    rows = [("SQL-1", "Injection", "high", CONTROLLER, 10), ("X-1", "x", "low", "gone.java", 3), ("X-2", "x", "low", "web/flaskapp.py", 4)]
    found = findings.shaped(spark.createDataFrame(rows, "rule_id string, rule_name string, severity string, file_path string, line_number int"))
    cases = casefile.contexts(found, code)
    got = {r.rule_id: r for r in cases.collect()}
    one = got["SQL-1"]
    assert ">>>   10 |         statement.executeQuery(sql);" in one.code and one.imports == ["package app.web;"] and one.class_context.startswith("public class ReportController")
    assert one.method_context.endswith("public String report(@RequestParam(\"id\") String id, @RequestHeader String agent) {") and "GetMapping" in one.annotations
    assert one.framework_context.startswith("Spring MVC Controller, GET endpoint") and [r.line for r in one.related] == [29]
    assert got["X-1"].code == "" and got["X-1"].imports == [] and got["X-1"].class_context is None
    assert got["X-2"].imports == ["from flask import Flask"] and "@app.route('/login')" in got["X-2"].annotations and got["X-2"].key == "X-2:web/flaskapp.py:4"
    methods = callgraph.methods(corpus.files(spark)).cache()
    sites = callgraph.calls(corpus.files(spark), methods)
    edges = callgraph.edges(callgraph.resolved(sites, methods))
    at = findings.shaped(spark.createDataFrame([("C-1", "src/main/java/shop/Files.java", 13)], "rule_id string, file_path string, line_number int"))
    called = casefile.call_contexts(at, methods, edges).first()
    assert called.uid.endswith("helper.run:12") and [c.method for c in called.callers] == ["Files.open", "go"]  # calls resolve by name
    assert casefile.by_file(found).count() == 3


def test_questions_and_answers(spark, code, tmp_path):
    rows = [("SQL-1", "Injection", "high", CONTROLLER, 10), ("X-1", "x", "low", "gone.java", 3), ("X-2", "x", "low", "web/flaskapp.py", 4)]
    cases = casefile.contexts(findings.shaped(spark.createDataFrame(rows, "rule_id string, rule_name string, severity string, file_path string, line_number int")), code)
    asked = enrich.asked(cases, "false_positive")
    assert "$" not in asked.filter("rule_id = 'X-1'").first().prompt.replace("${", "")
    calls = []

    def provider(texts):
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return pd.Series(['{"verdict": "false_positive", "confidence": "high"}'] * len(texts))

    assert list(enrich.retried(provider, 3, 0.0)(pd.Series(["a"])))[0].startswith('{"verdict"') and len(calls) == 3
    with pytest.raises(TimeoutError):
        enrich.retried(lambda t: (_ for _ in ()).throw(TimeoutError()), 2, 0.0)(pd.Series(["a"]))
    fixed = lambda texts: texts.map(lambda p: '```json\n{"verdict": "%s"}\n```' % ("true_positive" if "SQL-1" in p else "uncertain"))
    path = str(tmp_path / "cache")
    replies = enrich.answered(asked, fixed, enrich.load(spark, path)).cache()
    assert tuple(enrich.verdicts(replies).first()) == (3, 1, 0, 2, "0.0%")
    enrich.save(replies, path)
    again = enrich.answered(asked, lambda t: 1 / 0, enrich.load(spark, path))
    used = enrich.usage(again).first()
    assert (used.requests, used.cache_hits, used.hit_rate, used.output_tokens, used.cost) == (3, 3, 1.0, 0, 0.0) and enrich.usage(replies).first().input_tokens > 100
    enrich.clear(spark, path)
    assert enrich.load(spark, path).count() == 0
    reports.write_enhanced_json(replies, str(tmp_path / "e.json"), {"target": "t"}, {"requests": 3})
    assert (tmp_path / "e.json").read_text().count('"rule_id"') == 3


def test_candidates_and_first_ranked(spark):
    rows = [(k, f"R-{k}", s) for k, s in enumerate(["low", "high", "critical", "high", "info", "critical"])]
    found = findings.shaped(spark.createDataFrame(rows, "match_no int, rule_id string, severity string"))
    assert [r.rule_id for r in enrich.candidates(found, "high", 3).collect()] == ["R-2", "R-5", "R-1"]
    assert [r.rule_id for r in enrich.first_ranked(found, 3).collect()] == ["R-2", "R-1", "R-0"]


def test_documents_of_findings(spark, tmp_path):
    import json

    found = findings.shaped(spark.createDataFrame([("R-1", "t", "high", "/b/x.java", 3, "a < b\x01", "CWE-89", {"k": "v"}), ("R-2", None, "low", "/b/y.java", 4, None, None, {"suppressed": "true"})], "rule_id string, rule_name string, severity string, file_path string, line_number int, snippet string, cwe string, metadata map<string,string>"))
    whole = json.loads(reports.sarif(found, "t", "1", "/b", scanned=spark.createDataFrame([("/b/x.java",)], "path string")))
    run = whole["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["R-1"] and run["artifacts"][0]["location"]["uri"] == "x.java" and run["invocations"][0]["endTimeUtc"].endswith("Z")
    assert run["tool"]["driver"]["rules"][0]["helpUri"].endswith("/89.html") and len(json.loads(reports.sarif(found, "t", "1", include_suppressed=True))["runs"][0]["results"]) == 2
    reports.write_sarif(found, str(tmp_path / "f.sarif"), "t", "1", "/b")
    assert json.loads((tmp_path / "f.sarif").read_text())["runs"][0]["results"] == run["results"]
    reports.write_json(found, str(tmp_path / "f.json"), {"target": "/b"})
    text = json.loads((tmp_path / "f.json").read_text())
    assert (text["total_findings"], text["summary"]["high"], len(text["findings"])) == (2, 1, 2)
    spreadsheet.write(found, str(tmp_path / "f.xlsx"), 7)
    with zipfile.ZipFile(tmp_path / "f.xlsx") as book:
        assert book.testzip() is None
        import xml.etree.ElementTree as ET

        sheets = [ET.fromstring(book.read(f"xl/worksheets/sheet{k}.xml")) for k in (1, 2)]
    cells = ["".join(c.itertext()) for c in sheets[1].iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}c")]
    assert cells[:4] == ["Finding ID", "Title", "OWASP Category", "Severity"] and cells[9:13] == ["R-1", "t", "", "HIGH"] and len(cells) == 27
    assert "7" in ["".join(c.itertext()) for c in sheets[0].iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}c")]


def test_hooks(tmp_path):
    with pytest.raises(FileNotFoundError):
        hooks.install(str(tmp_path))
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    old = tmp_path / ".git/hooks/pre-commit"
    old.parent.mkdir(exist_ok=True)
    old.write_text("#!/bin/sh\necho old\n")
    assert hooks.install(str(tmp_path), rules="/r s") == ["installed pre-commit (backup: pre-commit.backup)", "installed pre-push"]
    assert "--staged" in old.read_text() and os.access(old, os.X_OK) and subprocess.run(["sh", "-n", str(old)]).returncode == 0
    assert hooks.uninstall(str(tmp_path)) == ["pre-commit: removed, backup restored", "pre-push: removed"] and "echo old" in old.read_text()
    assert hooks.uninstall(str(tmp_path)) == ["pre-commit: not one of ours", "pre-push: not installed"]


def test_own_analyzers(spark, code):
    own = registry.Registry()

    @own.language(".go", ".rs")
    def todo(path, content):
        return [{"rule_id": "TODO-1", "line_number": 1}] if "func" in content or "fn" in content else []

    @own.iac("dockerfile")
    def bad(path, content):
        raise ValueError

    own.framework("Django")(lambda path, content: [{"rule_id": "DJ-1", "severity": "low"}] if path.endswith("urls.py") else [])
    assert keys(own.run(code, ["django"]), "rule_id", "file_path", "engine") == [("DJ-1", "web/urls.py", "custom:framework"), ("TODO-1", "svc/handler.go", "custom:language"), ("TODO-1", "svc/store.rs", "custom:language")]
    assert own.stats() == {"language_analyzers": 1, "framework_analyzers": 1, "iac_analyzers": 1, "supported_extensions": 3}
    own.clear()
    assert own.run(code).count() == 0 and registry.built_in()["languages"] == 7


def test_profile(spark):
    p = Profile()
    p.record("b", 1.0)
    p.record("a", 0.5)
    p.record("a", 1.5)
    with p.measure("c"), p.memory("c"):
        _ = [0] * 100_000
    assert [x[:2] for x in p.summary()] == [("a", 2), ("b", 1), ("c", 1)] and p.rate("a") == 1.0 and p.rate("z") == 0.0 and p.peak_bytes["c"] > 100_000
    assert [(r.name, r.n, r.total) for r in registry.timed_counts(p.table(spark)).collect()][:2] == [("a", 2, 2.0), ("b", 1, 1.0)]
    assert p.timed(len)([1, 2]) == 2


def test_changed_and_scannable_files(spark, code):
    paths = spark.createDataFrame([("svc/handler.go",), ("order.rb",), ("svc/Item.swift",), ("gone.py",)], "path string")
    assert sorted(r.path for r in files.scannable(code, paths).collect()) == ["svc/handler.go"]  # whole paths: a name alone is another file
    assert sorted(r.path for r in files.scannable(code, spark.createDataFrame([("order.rb",), ("handler.go",)], "path string"), "svc").collect()) == ["svc/handler.go", "svc/order.rb"]


def test_numbers_follow_the_report(spark):
    rows = [(f"R-{k % 7}", ["low", "critical", "high"][k % 3], f"f{k % 11}", k % 5, k) for k in range(500)]
    found = findings.shaped(spark.createDataFrame(rows, "rule_id string, severity string, file_path string, line_number int, match_no int").repartition(6))
    numbered = [(r.finding_no, r.severity_rank, r.file_path, r.line_number, r.match_no) for r in findings.numbered(found).collect()]
    wanted = sorted(numbered, key=lambda r: (-r[1], *r[2:]))
    assert [r[0] for r in wanted] == list(range(1, 501))


def test_a_whole_scan_holds_every_engine(spark, code):
    both = code.unionByName(corpus.files(spark))
    engines = {r.engine for r in Scan(context_aware=False).run(both, rules.from_rows(spark, corpus.RULES)).select("engine").distinct().collect()}
    assert {"pattern", "secret", "ast", "dataflow", "spring", "mybatis", "language:go", "framework:flask", "iac:dockerfile"} <= engines


def test_starter_rules(spark, tmp_path):
    from lodestone.plans.cli import STARTER

    table = rules.from_yaml(spark, str(STARTER))
    assert table.count() >= 20 and table.filter("size(patterns) = 0").count() == 0
    texts = {
        "a.py": 'import os\nos.system(x)\nrequests.get(u, verify=False)\nyaml.load(f)\ncur.execute(f"select {x}")\n', "B.java": 'x.executeQuery("select " + y);\nMessageDigest.getInstance("MD5");\n', "c.js": "el.innerHTML = x;\ndb.query(`select ${a}`);\n",
        "d.pem.txt": "-----BEGIN RSA PRIVATE KEY-----\n", "E.java": 'DocumentBuilderFactory.newInstance().setFeature("disallow-doctype-decl", true);\n',
    }
    found = keys(onepass.scan(files.from_table(spark.createDataFrame(list(texts.items()), "path string, content string")), table, ("rules",)))
    assert found == [
        ("START-CMD-002", "a.py", 2), ("START-CRY-001", "B.java", 2), ("START-DES-002", "a.py", 4), ("START-SEC-002", "d.pem.txt", 1), ("START-SQLI-001", "B.java", 1),
        ("START-SQLI-002", "a.py", 5), ("START-SQLI-003", "c.js", 2), ("START-TLS-001", "a.py", 3), ("START-XSS-001", "c.js", 1),
    ]
