"""SQL texts that state the same results for DuckDB: checks, rules and corpora as queries."""

from __future__ import annotations

from lodestone.operators.check_tables import Check
from lodestone.sources import corpus
from lodestone.sources.corpus import quoted


def lit(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def pattern(p: str, flags: str = "") -> str:
    return quoted(f"(?{flags}){p}" if flags else p)


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def matches(source: str, expression: str, keep: str = "path") -> str:
    """A query of (keep, i, head, matched, line): all matches of a pattern in the column content of a query."""
    return f"""
SELECT {keep}, content, i, head, matched, CAST({newlines("head")} + 1 AS INTEGER) AS line FROM (
  SELECT {keep}, content, i, m[i] AS matched,
         array_to_string(list_transform(range(1, i + 1), lambda k: p[k] || CASE WHEN k < i THEN m[k] ELSE '' END), '') AS head
  FROM (SELECT {keep}, content, m, p, unnest(range(1, len(m) + 1)) AS i
        FROM (SELECT {keep}, content, regexp_extract_all(content, {expression}) AS m, string_split_regex(content, {expression}) AS p
              FROM ({source}) WHERE regexp_matches(content, {expression}))))"""


def check_queries(checks: tuple[Check, ...], where: str) -> str:
    """(file_path, rule_id, pattern_idx, match_no, line_number, severity, confidence, cwe, owasp) of a check table over the corpus."""
    parts = []
    for c in checks:
        gate = [where]
        if c.extensions:
            gate.append(f"ext IN ({', '.join(map(quoted, c.extensions))})")
        if c.has:
            gate.append("(" + " OR ".join(f"contains(content, {quoted(x)})" for x in c.has) + ")")
        gate += [f"NOT contains(content, {quoted(x)})" for x in c.hasnt]
        if c.path:
            gate.append(f"contains(lower(path), {quoted(c.path)})")
        source = f"SELECT path, content FROM ({corpus.sql()}) WHERE {' AND '.join(gate)}"
        fixed = f"{quoted(c.confidence)} AS confidence, {quoted(c.cwe)} AS cwe, {quoted(c.owasp)} AS owasp"
        head = f"path AS file_path, {quoted(c.rule_id)} AS rule_id"
        if c.absent:
            parts.append(f"SELECT {head}, 0 AS pattern_idx, 1 AS match_no, 1 AS line_number, {quoted(c.severity)} AS severity, {fixed} FROM ({source})")
        for k, p in enumerate(c.patterns):
            expression = pattern(p, c.flags)
            if c.above:
                parts.append(f"SELECT {head}, {k} AS pattern_idx, 1 AS match_no, 1 AS line_number, {quoted(c.severity)} AS severity, {fixed} FROM ({source}) WHERE len(regexp_extract_all(content, {expression})) > {c.above}")
                continue
            before = f"right(head, {c.around[0]})" if c.around[0] else "''"
            around = f"({before} || matched || substr(content, length(head) + length(matched) + 1, {c.around[1]}))"
            keep = ["TRUE"]
            if c.within:
                keep.append("(" + " OR ".join(f"contains(lower(matched), {quoted(x)})" for x in c.within) + ")")
            keep += [f"NOT contains({around if c.around[0] else f'lower({around})'}, {quoted(x)})" for x in c.near]
            if c.only:
                keep.append(f"i <= {c.only}")
            severity = quoted(c.severity)
            if c.raised:
                severity = f"CASE WHEN {' OR '.join(f'contains({around}, {quoted(x)})' for x in c.raised_by)} THEN {quoted(c.raised)} ELSE {severity} END"
            parts.append(f"SELECT {head}, {k} AS pattern_idx, CAST(i AS INTEGER) AS match_no, line AS line_number, {severity} AS severity, {fixed} FROM ({matches(source, expression)}) WHERE {' AND '.join(keep)}")
    return "\nUNION ALL\n".join(parts)


#: Findings made from the rows of lineitem, to give relational operators volume.
FINDINGS = """
SELECT ['SQLI-001', 'XSS-002', 'LOG-001', 'CMD-001', 'SECRET-003'][1 + l_suppkey % 5] AS rule_id,
       ['critical', 'high', 'medium', 'low', 'info'][1 + l_partkey % 5] AS severity,
       ['high', 'medium', 'low'][1 + l_orderkey % 3] AS confidence,
       'src/f' || (l_orderkey % 97) || '.java' AS file_path,
       CAST(l_quantity AS INTEGER) AS line_number,
       ['CWE-89', 'CWE-79', NULL, 'CWE-78', 'CWE-798'][1 + l_suppkey % 5] AS cwe,
       ['A03', 'A03', 'A09', NULL, 'A07'][1 + l_suppkey % 5] AS owasp,
       CAST(l_linenumber AS INTEGER) AS engine_seq, CAST(l_partkey AS INTEGER) AS rule_ord, CAST(l_suppkey AS INTEGER) AS pattern_idx, CAST(l_orderkey AS INTEGER) AS match_no
FROM lineitem
"""
RANK = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"

#: Paths made from documents.
PATHS = """
SELECT doc_id, concat('/', source, '/', CASE WHEN doc_id % 7 = 0 THEN 'test/' WHEN doc_id % 11 = 0 THEN 'vendor/' WHEN doc_id % 13 = 0 THEN 'node_modules/' ELSE '' END,
              'doc_', doc_id, CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.java' WHEN 'de' THEN '.txt' ELSE '.yml' END) AS path, coalesce(text, '') AS content
FROM documents
"""
