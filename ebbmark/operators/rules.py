"""The rules table: which source column becomes which target column, and how.

A rules table has tens of rows. It is read once while a plan is being built and turned into column
expressions; no data row ever meets it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbmark.functions.names import is_business_key
from ebbmark.operators.match import best_match


# The columns of a rules table, in order.
@dataclass(frozen=True)
class Rule:
    source_schema: str | None = None
    source_table: str | None = None
    source_column: str | None = None
    target_schema: str | None = None
    target_table: str | None = None
    target_column: str | None = None
    transformation_type: str | None = None
    transformation_logic: str | None = None

    @property
    def kind(self) -> str:
        return (self.transformation_type or "").lower()


RULE_COLUMNS = tuple(f.name for f in fields(Rule))
RULE_SCHEMA = "approved string, " + ", ".join(f"{name} string" for name in RULE_COLUMNS)


def rules_from(rows: Iterable[Mapping[str, str | None]]) -> list[Rule]:
    return [Rule(**{name: row.get(name) for name in RULE_COLUMNS}) for row in rows]


def approved(rules: DataFrame) -> DataFrame:
    """All rules but those marked false; a table without the mark is approved as a whole."""
    if "approved" not in rules.columns:
        return rules
    return rules.where(F.coalesce(F.lower(F.col("approved").cast("string")), F.lit("")) != "false")


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The approved rules of a CSV file, in file order."""
    table = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rules_from(row.asDict() for row in approved(table).collect())


def save_rules(spark: SparkSession, rules: Iterable[Rule], path: str) -> None:
    """Write rules as CSV, marked approved; missing texts are written empty."""
    rows = [tuple(["True"] + [getattr(rule, name) or "" for name in RULE_COLUMNS]) for rule in rules]
    spark.createDataFrame(rows, RULE_SCHEMA).coalesce(1).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', emptyValue=""
    )


def rules_summary(rules: DataFrame) -> DataFrame:
    """Number of rules per target table."""
    return rules.groupBy("target_table").agg(F.count(F.lit(1)).alias("rules"))


def rules_by_table(rules: list[Rule], tables: list[str]) -> tuple[dict[str, list[Rule]], list[str]]:
    """Rules grouped by the available table their target name means, and the names that mean none."""
    named: dict[str, list[Rule]] = {}
    for rule in rules:
        if rule.target_table:
            named.setdefault(rule.target_table, []).append(rule)
    matched: dict[str, list[Rule]] = {}
    claimed: dict[str, str] = {}
    unmatched = []
    for name in sorted(named):
        table = name if name in tables else best_match(name, tables)
        if table is None:
            unmatched.append(name)
        elif table in matched:
            raise ValueError(f"Target tables '{claimed[table]}' and '{name}' both mean table '{table}'")
        else:
            matched[table], claimed[table] = named[name], name
    if rules and not matched:
        raise ValueError(
            f"None of the target tables {sorted(named)} of {len(rules)} rules matches an available table: {tables}"
        )
    return matched, unmatched


def missing_business_keys(source: list[str], produced: Iterable[str]) -> list[str]:
    """Business keys of the source that a projection would lose."""
    produced = set(produced)
    return [name for name in source if is_business_key(name) and name not in produced]
