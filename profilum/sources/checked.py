"""Loads that hold rows to rules while they write them.

One pass over the source writes every row once, the good ones apart from those that break a rule, and counts per
rule on the way. The load is committed only if few enough rows are bad. Otherwise nothing but an unnamed folder is
left behind, which the error names, and readers go on with the version before.

A rule is a condition on a row; NULL breaks it. Null rows, repeated rows and further columns are rows like others.
An empty source commits an empty version.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from profilum.operators.documents import missing_columns
from profilum.sources.files import read_csv

GOOD, BROKEN = "load_accepted", "broken_rules"
LOG = "number bigint, path string, schema string, rows_checked bigint, rows_refused bigint, violations map<string,bigint>"
# Rules of a source whose lines could not all be read.
PARSES = {"row parses": "_bad_row IS NULL"}


@dataclass(frozen=True)
class Load:
    """A written load: its rows, those refused with their reasons, and the counts."""

    number: int
    path: str
    schema: StructType
    rows_checked: int
    rows_refused: int
    violations: dict[str, int]

    def _rows(self, spark: SparkSession) -> DataFrame:
        # The schema is given, as a load without rows has no files.
        whole = StructType([*self.schema.fields]).add(BROKEN, ArrayType(StringType())).add(GOOD, BooleanType())
        return spark.read.schema(whole).parquet(self.path)

    def accepted(self, spark: SparkSession) -> DataFrame:
        return self._rows(spark).filter(F.col(GOOD)).drop(GOOD, BROKEN)

    def refused(self, spark: SparkSession) -> DataFrame:
        """The rows that break a rule, with the names of all rules they break."""
        return self._rows(spark).filter(~F.col(GOOD)).drop(GOOD)

    def report(self, spark: SparkSession) -> DataFrame:
        rows = [(name, self.rows_checked, count) for name, count in self.violations.items()]
        return spark.createDataFrame(rows, "rule string, rows_checked bigint, violations bigint")


class RulesBroken(ValueError):
    """Too many rows break rules; ``load`` tells which, and its rows can be read."""

    def __init__(self, load: Load, bound: float) -> None:
        super().__init__(f"{load.rows_refused} of {load.rows_checked} rows break rules, more than {bound:.2%}: {load.violations}; see {load.path}")
        self.load = load


def checked_load(rows: DataFrame, root: str, rules: dict[str, str], bound: float = 0.01, kind: str | None = None) -> Load:
    """Write ``rows`` as the next version under ``root`` if at most the share ``bound`` of them breaks rules.

    ``kind`` names a kind of table whose required columns must be there. The counts come from the writing tasks
    themselves. There is no shuffle: each task writes its input split, so a third of all rows with one value
    matters to nobody.
    """
    lacking = missing_columns(rows, kind) if kind else []
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    taken = {GOOD, BROKEN} & set(rows.columns)
    if taken:
        raise ValueError(f"columns with names of the load: {', '.join(sorted(taken))}")
    spark, names = rows.sparkSession, list(rules)
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(rules[name]), F.lit(False)), F.lit(name)) for name in names]), lambda name: name.isNotNull()) if names else F.array().cast("array<string>")
    judged = rows.withColumn(BROKEN, broken).withColumn(GOOD, F.size(BROKEN) == 0)
    seen = Observation()
    counts = [F.count_if(F.array_contains(BROKEN, name)).alias(f"rule_{place}") for place, name in enumerate(names)]
    path = f"{root.rstrip('/')}/load-{uuid.uuid4().hex}"
    judged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~F.col(GOOD)).alias("refused"), *counts).write.partitionBy(GOOD).parquet(path)
    found = seen.get
    newest = current(spark, root)
    number = newest.number + 1 if newest else 1
    load = Load(number, path, rows.schema, found["rows"], found["refused"], {name: found[f"rule_{place}"] for place, name in enumerate(names)})
    if load.rows_refused > bound * load.rows_checked:
        raise RulesBroken(load, bound)
    entry = (number, path, rows.schema.json(), load.rows_checked, load.rows_refused, load.violations)
    # Of two writers of the same number the second fails.
    spark.createDataFrame([entry], LOG).coalesce(1).write.mode("errorifexists").parquet(f"{root.rstrip('/')}/log/version={number}")
    return load


def checked_csv(spark: SparkSession, path: str, schema: str, root: str, rules: dict[str, str], bound: float = 0.01, kind: str | None = None) -> Load:
    """The load of a CSV file. Lines that do not fit the schema are refused as ``row parses``; their text is in
    ``_bad_row``, which accepted rows have as NULL."""
    return checked_load(read_csv(spark, path, schema, strict=False), root, {**PARSES, **rules}, bound, kind)


def current(spark: SparkSession, root: str) -> Load | None:
    """The load committed last, or None."""
    try:
        row = spark.read.schema(LOG).parquet(f"{root.rstrip('/')}/log").orderBy(F.desc("number")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if row is None:
        return None
    return Load(row.number, row.path, StructType.fromJson(json.loads(row.schema)), row.rows_checked, row.rows_refused, row.violations)
