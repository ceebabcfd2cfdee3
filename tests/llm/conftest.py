import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the old river bank today again",
    "The quick brown fox jumps over the lazy dog near the old river bank today again",
    " the  quick brown fox\tjumps over the lazy dog near the old river bank today again ",
    "",
    None,
    " \n\t ",
    "one",
    "Éà ñandú straße 中文 words " * 40,
    "it's a test, isn't it? 12345 tokens!!  end\n\n\nnew  line " * 30,
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau",
    "prefix words here alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau and after",
    " ".join(f"w{i % 97}x{i % 13}" for i in range(6000)),
    "x" * 5000,
    "Released under the MIT License. And some words more.",
    "<|endoftext|> is only text <|startoftext|>",
]


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty, long, tied and repeated rows."""
    out = [(i, t) for i, t in enumerate(TEXTS)]
    return out + [(20 + i, TEXTS[9] + f" tail{i}") for i in range(5)] + [(0, TEXTS[0]), (None, TEXTS[0]), (None, None), (30, TEXTS[11] + " more")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with what operators add or use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, component_id long, `a b` string, t string"
    return spark.createDataFrame([(i, t, None, "s", None, True, 0.5, 7, "z", "u") for i, t in rows], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
