import math

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.regex import glob, java, matches


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_matches_have_the_lines_of_python(spark):
    import re

    text = "a1\n\nb2 b3\nc\n4\n"
    found = one(spark, matches(F.col("t"), java(r"\w\d|\n4")), t=text)
    assert [(r.line, r.matched) for r in found] == [(text.count("\n", 0, m.start()) + 1, m[0]) for m in re.finditer(r"\w\d|\n4", text)]
    assert one(spark, matches(F.col("t"), "zz"), t=text) == []


def test_matches_around(spark):
    found = one(spark, matches(F.col("t"), "X", 3), t="abcdXefgXh")
    assert [(r.before, r.after) for r in found] == [("bcd", "efg"), ("efg", "h")]


def test_entropy(spark):
    assert one(spark, T.entropy(F.col("t")), t="") == 0.0
    assert abs(one(spark, T.entropy(F.col("t")), t="aab") - (-(2 / 3) * math.log2(2 / 3) - (1 / 3) * math.log2(1 / 3))) < 1e-9
    assert spark.createDataFrame([(None,)], "t string").select(T.entropy("t").alias("x")).first().x == 0.0


def test_nosec(spark):
    assert one(spark, T.nosec(F.col("t")), t="x = 1") is None
    assert one(spark, T.nosec(F.col("t")), t="x = 1  # nosec") == []
    assert one(spark, T.nosec(F.col("t")), t="x  // NOSEC A-1, B-2") == ["A-1", "B-2"]
    assert one(spark, T.suppressed(F.col("t"), F.lit("A-1")), t="/* nosec A-1") is True
    assert one(spark, T.suppressed(F.col("t"), F.lit("A-2")), t="/* nosec A-1") is False


def test_secrets(spark):
    assert one(spark, T.assigned_value(F.col("t")), t="key = 'abc'") == "abc"
    assert one(spark, T.likely_secret(F.col("t")), t="short") is False
    assert one(spark, T.likely_secret(F.col("t")), t="my_password_1") is False
    assert one(spark, T.likely_secret(F.col("t")), t="q8Zr2LmX0vTn7KsB4yHdW1cP") is True
    assert one(spark, T.likely_secret(F.col("t")), t="a" * 24) is False
    assert one(spark, T.secret_value(F.col("t")), t="k = abcdefghijklmnopqrstuvwx") == "abcdefghijklmnopqrstuvwx"
    assert one(spark, T.valid_secret(F.col("t")), t="nothing") is True


def test_names(spark):
    assert one(spark, T.suffix(F.col("t")), t="/a/b.tar.GZ") == ".gz"
    assert one(spark, T.suffix(F.col("t")), t="/a/.env") == ""
    assert one(spark, T.class_guess(F.col("t")), t="this.order_item") == "OrderItem"
    assert one(spark, T.html_escape(F.col("t")), t="<a href='x'>&") == "&lt;a href=&#x27;x&#x27;&gt;&amp;"
    assert one(spark, F.col("t").rlike(glob("a*[!b].?s")), t="a/xc.js") is True


def test_replies(spark):
    schema = "ok boolean"
    assert one(spark, T.parsed_reply(F.col("t"), schema), t='so: ```json\n{"ok": true}\n```').ok is True
    assert one(spark, T.parsed_reply(F.col("t"), schema), t='well {"ok": false} done').ok is False
    assert one(spark, T.template("a $x ${y} $z", {"x": F.lit("1"), "y": F.lit("2")})) == "a 1 2 $z"
