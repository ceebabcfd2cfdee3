import sys

import pytest
from pyspark import cloudpickle

from lodestone.operators import tablefunctions as tf

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


def todo(path, content):
    if content == "bad":
        raise RuntimeError("cannot read")
    return [{"rule_id": "TODO", "line_number": n} for n, line in enumerate(content.split("\n"), 1) if "TODO" in line]


class Count(tf.ProjectAnalyzer):
    def __init__(self):
        self.paths = []

    def file(self, path, content):
        self.paths.append(path)
        return [{"rule_id": "EMPTY"}] if not content else ()

    def finish(self):
        yield {"rule_id": "FILES", "description": ",".join(self.paths)}


@pytest.fixture
def table(spark):
    rows = [("p", "b.py", "x\nTODO y"), ("p", "a.py", None), ("q", "c.py", "bad"), ("q", "d.py", "TODO\nTODO")]
    spark.createDataFrame(rows, "project string, path string, content string").createOrReplaceTempView("files_table")


def test_file_analyzer_from_sql(spark, table):
    tf.register(spark, "todo", tf.of_files(todo, ("project",)))
    rows = spark.sql("SELECT project, path, rule_id, line_number, severity, error FROM todo(TABLE(files_table))").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("p", "b.py", "TODO", 2, "medium", None), ("q", "c.py", None, None, None, "RuntimeError: cannot read"), ("q", "d.py", "TODO", 1, "medium", None), ("q", "d.py", "TODO", 2, "medium", None)]))
    with_severity = spark.sql("SELECT t.path, s.weight FROM todo(TABLE(files_table)) t JOIN VALUES ('medium', 2) AS s(severity, weight) USING (severity)")
    assert with_severity.count() == 3
    assert spark.sql("SELECT * FROM todo(TABLE(SELECT * FROM files_table WHERE false))").collect() == []


def test_project_analyzer_sees_a_partition_in_order(spark, table):
    tf.register(spark, "counted", tf.of_projects(Count, ("project",)))
    rows = spark.sql("SELECT project, path, rule_id, description FROM counted(TABLE(files_table) PARTITION BY project ORDER BY path)").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("p", "a.py", "EMPTY", None), ("p", None, "FILES", "a.py,b.py"), ("q", None, "FILES", "c.py,d.py")]))


def test_tables_without_what_is_needed_are_refused(spark, table):
    tf.register(spark, "todo", tf.of_files(todo, ("project",)))
    with pytest.raises(Exception, match="the table lacks project"):
        spark.sql("SELECT * FROM todo(TABLE(SELECT path, content FROM files_table))").collect()
