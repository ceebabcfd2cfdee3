import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions.text import SECRET_VALUES
from lodestone.operators import check_tables
from lodestone.operators.manypatterns import Candidates, Pattern, folded, matched, required


@pytest.mark.parametrize(
    ("pattern", "flags", "literals"),
    [
        (r"executeQuery\s*\(", 0, {"executequery"}), (r"(?:api|auth)_?(?:key|token)\s*=", 0, {"key", "token"}), (r"[Pp]assword", 0, {"password"}), (r"a|bcd", 0, set()), (r"(abc)+x?", 0, {"abc"}), (r"(abc)*", 0, set()),
        (r"\bfoo\b.*\bbarbaz\b", 0, {"barbaz"}), (r"(?=.*needle)x", 0, {"needle"}), (r"(?!needle)x", 0, set()), (r"café noir", 0, {" noir"}), (r"[", 0, set()), (r"ab", 0, set()), (r"(?i)K[s]ts", 0, {"ksts"}), (r"(x)\1abcd", 0, {"abcd"}), (r"a b c d", re.X, {"abcd"}),
    ],
)
def test_required_literals(pattern, flags, literals):
    assert required(pattern, flags) == literals


PATTERNS = [r"(?i)kiss", r"tok(?:en|es)\s*=\s*\w+", r"^import (\w+)$", r"sel[e3]ct.+?from", r"x{2,}yzz", r"[^a]bcd", r"(?i)straße", r"\d{3}-\d{4}", r"(?:foo|ba+r)qux", r"a.{0,3}?end", r"(?<=pre)fix", r"(?<!pre)fix", r"é|ñandu"]
PIECES = ["KISS", "kiſs", "Kiss", "kİss", "kıss", "token = a1", "tokes=b", "\nimport os\n", "select a from", "sel3ct \n from", "xxxyzz", "bcd", "abcd", "STRASSE", "Straße", "555-1234", "fooqux", "baaarqux", "aqqend", "prefix", "fix", "é", "ñandu", " ", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_no_match_is_lost(text):
    candidates = Candidates({k: (p, re.M) for k, p in enumerate(PATTERNS)})
    found = {k for k, p in enumerate(PATTERNS) if re.search(p, text, re.M)}
    assert found <= candidates.of(text)


def test_folding_covers_what_ignoring_case_matches():
    letters = [chr(c) for c in range(0x250)] + ["K", "ẞ"]
    for a in "abcdefghijklmnopqrstuvwxyz":
        for c in letters:
            if re.fullmatch(a, c, re.I):
                assert folded(c) == a


def test_most_patterns_of_the_tables_have_literals():
    tables = [t for _, t in [*check_tables.LANGUAGES.values(), *check_tables.FRAMEWORKS.values()]] + [check_tables.TERRAFORM, check_tables.KUBERNETES, check_tables.DOCKERFILE, check_tables.CLOUDFORMATION]
    patterns = [p for table in tables for check in table for p in check.patterns] + list(SECRET_VALUES)
    assert sum(bool(required(p)) for p in patterns) > 0.8 * len(patterns)


def test_rows_equal_a_search_for_every_pattern(spark):
    texts = [(i, "".join(PIECES[(i * k) % len(PIECES)] for k in range(1, 9)), "x") for i in range(60)] + [(60, None, "x"), (61, "", "x"), (62, "kiss\n" * 5000, "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string, line string").repartition(3)
    wanted = [Pattern(k, p) for k, p in enumerate(PATTERNS)]
    got, plain = (sorted(map(tuple, matched(df, wanted, filtered=f).collect())) for f in (True, False))
    assert got == plain and len(got) > 5000
    assert {r[3] for r in got if r[0] == 62} == set(range(1, 5001))


def test_few_patterns_are_searched():
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in range(100)]
    candidates = Candidates({k: (rf"\b{w}\b", 0) for k, w in enumerate(words)})
    assert candidates.always == set() and len(candidates.of(" ".join(words[:7]))) < 30
