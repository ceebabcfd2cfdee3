"""A scan of files that arrive in any order, with what it knows of a project kept as state.

Which frameworks a project uses decides which checks apply to its files, and a
file that shows one may come long after the files it concerns.  Findings that
hang on a framework wait in the state of their project until a file shows it;
findings that were given out are remembered for a time and not given again.  So
any split of a tree into batches gives the rows of one scan.

A project is dealt over several buckets of its paths, each with its own state;
what shows a framework goes to all of them, so that one very large project is
the work of several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators import onepass
from lodestone.operators.check_tables import FRAMEWORKS
from lodestone.operators.checks import framework_signs
from lodestone.operators.findings import COLUMNS, FOUND, deduplicated

BUCKETS = 16
ENGINES = ("rules", "frameworks", "languages", "iac")
_OUT = "project string, finding string"


class Waiting(StatefulProcessor):
    """State of one bucket of a project: frameworks that were seen, findings that wait for one, and findings that were given."""

    def __init__(self, remembered: int | None) -> None:
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getMapState("shown", "gate string", "yes int")
        self.waiting = handle.getMapState("waiting", "gate string, id string", "finding string")
        self.given = handle.getMapState("given", "id string", "yes int", self.remembered)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        project, out = key[0], []
        opened = set()
        for batch in rows:
            for gate, id_, finding in batch.sort_values("place")[["gate", "id", "finding"]].itertuples(index=False, name=None):
                if pd.isna(finding):  # a file that shows a framework
                    if not self.shown.containsKey((gate,)):
                        self.shown.updateValue((gate,), (1,))
                        opened.add(gate)
                elif pd.isna(gate) or self.shown.containsKey((gate,)):
                    self._give(id_, finding, out)
                else:
                    self.waiting.updateValue((gate, id_), (finding,))
        if opened:
            for (gate, id_), (finding,) in list(self.waiting.iterator()):
                if gate in opened:
                    self._give(id_, finding, out)
                    self.waiting.removeKey((gate, id_))
        yield pd.DataFrame({"project": [project] * len(out), "finding": out}, dtype=object)

    def _give(self, id_: str, finding: str, out: list[str]) -> None:
        if not self.given.containsKey((id_,)):
            self.given.updateValue((id_,), (1,))
            out.append(finding)

    def close(self) -> None:
        pass


def arriving(files: DataFrame, rules: DataFrame, project: str = "project", engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """(project, bucket, gate, id, finding): every file's findings, as text, with the framework each hangs on, and the frameworks that files show.

    files: the files table with a column that names the project.
    """
    tagged = files.withColumn("path", F.to_json(F.struct(F.col(project).alias("project"), F.col("path"))))
    found = onepass.scan(tagged, rules, engines, present=set(FRAMEWORKS))
    where = F.from_json("file_path", "project string, path string")
    found = found.withColumns({"__project": where["project"], "file_path": where["path"]})
    gate = F.when(F.col("engine").startswith("framework:"), F.substring_index("engine", ":", -1))
    order = F.concat_ws(":", *[F.lpad(F.coalesce(F.col(c), F.lit(0)).cast("string"), 6, "0") for c in FOUND])
    own = found.select(
        F.col("__project").alias("project"), F.pmod(F.xxhash64("file_path"), F.lit(BUCKETS)).cast("int").alias("bucket"), gate.alias("gate"),
        F.concat_ws("\x00", "rule_id", "file_path", F.col("line_number").cast("string")).alias("id"), F.to_json(F.struct(*COLUMNS)).alias("finding"), order.alias("place"),
    )
    shown = F.array_compact(F.array(*[F.when(sign, F.lit(name)) for name, sign in framework_signs().items() if name in FRAMEWORKS]))
    signs = files.select(F.col(project).alias("project"), F.explode(shown).alias("gate"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("finding"), F.lit("").alias("place"))
    signs = signs.select("project", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("bucket"), "gate", "id", "finding", "place")
    return own.unionByName(signs)


def scanned(files: DataFrame, rules: DataFrame, project: str = "project", engines: tuple[str, ...] = ENGINES, remembered: int | None = None) -> DataFrame:
    """A stream of findings (project and the columns of findings) of a stream of files, each given once.

    The session needs the RocksDB state store.  remembered: milliseconds for
    which given findings are remembered, after which a file that comes again
    is new; None remembers all, and state grows with the findings.  Spark runs
    batches without data for as long as state can expire, so give a time to
    streams that go on, and none to those that end (availableNow).  Of several findings of one
    rule, file and line the first that arrives is given; reports deduplicate
    again, which changes nothing within one file's batch.
    """
    rows = arriving(files, rules, project, engines)
    out = rows.groupBy("project", "bucket").transformWithStateInPandas(Waiting(remembered), _OUT, "append", "None" if remembered is None else "ProcessingTime")
    columns = ", ".join(f"`{c}` {t}" for c, t in COLUMNS.items())
    return out.select("project", F.from_json("finding", columns).alias("f")).select("project", "f.*")


def once(files: DataFrame, rules: DataFrame, engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """What one scan of all files of one project gives: what any split into batches has to give."""
    return deduplicated(onepass.scan(files, rules, engines))
