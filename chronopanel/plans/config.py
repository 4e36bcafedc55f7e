"""Controllers as stored tables, checked before any job runs.

A row is one stage: ``column`` it belongs to, ``stage`` number, ``operator``, ``source`` (prefix of the
input, empty or null for the column itself) and ``prefix`` (of the output; null for the operator's own).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from chronopanel.panel import Panel
from chronopanel.plans.spec import OPERATORS, Controller, Recipe, Stage, steps_for

SCHEMA = "column string, stage int, operator string, source string, prefix string"
#: A controller is configuration; a table with more stages than this is taken for a mistake.
MOST_STAGES = 1_000_000


def controller_table(spark: SparkSession, controller: Controller) -> DataFrame:
    """The controller as a table."""
    rows = [(c, i, s.operator, s.source, s.prefix) for c, recipe in controller.items() for i, s in enumerate(recipe)]
    return spark.createDataFrame(rows, SCHEMA)


def controller_from_table(table: DataFrame, most: int = MOST_STAGES) -> dict[str, Recipe]:
    """The controller a table holds; raises on rows without column, number or operator and on stage numbers used twice."""
    rows = table.select("column", "stage", "operator", "source", "prefix").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the controller has more than {most} stages")
    stages: dict[str, dict[int, Stage]] = {}
    for r in rows:
        if r["column"] is None or r["stage"] is None or r["operator"] is None:
            raise ValueError(f"a stage needs column, number and operator: {tuple(r)}")
        if r["stage"] in stages.setdefault(r["column"], {}):
            raise ValueError(f"column {r['column']} has two stages {r['stage']}")
        stages[r["column"]][r["stage"]] = Stage(r["operator"], r["source"] or "", r["prefix"])
    return {c: tuple(found[i] for i in sorted(found)) for c, found in stages.items()}


def check_controller(columns: Sequence[str], panel: Panel, controller: Controller) -> None:
    """Raise one error that lists everything wrong with a controller for a table of these columns.

    Unknown operators, recipes of columns the table lacks, outputs named like a key, another output or a column of the
    table, and stages whose input nothing makes, or only stages that wait for them.
    """
    wrong = []
    values = [c for c in columns if c not in panel.keys]
    wrong += [f"no column {c} in the table" for c in controller if c not in values]
    made: dict[str, str] = dict.fromkeys(columns, "the table")
    waiting: list[tuple[str, str, list[str]]] = []
    for column, recipe in controller.items():
        known = [s for s in recipe if s.operator in OPERATORS]
        wrong += [f"unknown operator {s.operator} for column {column}" for s in recipe if s.operator not in OPERATORS]
        for stage, step in zip(known, steps_for(column, known)):
            outputs = list(step.expressions(panel))
            for name in outputs:
                if name in made:
                    wrong.append(f"{stage.operator} of column {column} makes {name}, which {made[name]} has")
                made.setdefault(name, f"{stage.operator} of column {column}")
            if step.operator.kind != "keep":
                waiting.append((stage.operator, step.source, outputs))
    present = set(columns)
    while any(source in present for _, source, _ in waiting):
        blocked = [w for w in waiting if w[1] not in present]
        present.update(name for w in waiting if w not in blocked for name in w[2])
        waiting = blocked
    for operator, source, _ in waiting:
        why = "is made only by stages that wait for each other" if source in made else "is made by no stage"
        wrong.append(f"{operator} needs {source}, which {why}")
    if wrong:
        raise ValueError("the controller cannot run: " + "; ".join(wrong))
