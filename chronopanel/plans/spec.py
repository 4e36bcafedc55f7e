"""Declaring which features a column gets.

A recipe is a list of stages; a stage names an operator, the prefix of its input
column (empty: the column itself) and the prefix of its output.  A controller maps
column names to recipes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Literal

from chronopanel.operators.history import LAG_ROWS, MOVING_ROWS, lag_columns, moving_distance_columns
from chronopanel.operators.scores import bucket_columns, tail_flag_columns
from chronopanel.operators.snapshot import known_statistics
from chronopanel.panel import Panel

Kind = Literal["keep", "distance", "rank", "score", "row", "history"]


@dataclass(frozen=True)
class Operator:
    """How a stage computes its columns.

    kind       keep      nothing to compute
               distance  value minus ``statistic`` of its snapshot, in units of its statistic ``unit`` if there is one
               rank      empirical distribution rank in its snapshot
               score     standard normal quantile
               row       expressions over the input column, from ``columns``
               history   expressions over the input's earlier values, from ``columns``;
                         those ``offsets`` snapshots back are there under the names
                         ``operators.history.earlier`` gives
    columns    (panel, input, output) -> {name: SQL expression}
    default    output prefix if the stage gives none
    """

    kind: Kind
    default: str = ""
    statistic: str | None = None
    unit: str | None = None
    offsets: tuple[int, ...] = ()
    columns: Callable[[Panel, str, str], dict[str, str]] | None = None
    fixed_names: bool = False


def _moving(statistic: str, prefix: str) -> Operator:
    offsets = tuple(range(1, max(MOVING_ROWS) + 1))
    return Operator(
        "history",
        prefix,
        offsets=offsets,
        columns=lambda panel, name, out: moving_distance_columns(panel, name, statistic, out),
    )


# Operator names as configuration tables spell them, and default prefixes.
OPERATORS: dict[str, Operator] = {
    "doNothing": Operator("keep"),
    "Cs_distanceFromMean": Operator("distance", "DM_", statistic="mean"),
    "Cs_distanceFromMin": Operator("distance", "DMI_", statistic="min"),
    "Cs_distanceFromMax": Operator("distance", "DMA_", statistic="max"),
    "Cs_distanceFromMedian": Operator("distance", "DME_", statistic="median", fixed_names=True),
    "Cs_ecdf": Operator("rank", "E_", fixed_names=True),
    "Cs_bucketize": Operator(
        "row", columns=lambda panel, name, out: bucket_columns(name), fixed_names=True
    ),
    "Cs_quantile": Operator("score", "Q_", fixed_names=True),
    "Cs_naiveOutliers": Operator(
        "row", columns=lambda panel, name, out: tail_flag_columns(name), fixed_names=True
    ),
    "Ts_distanceFromMovingAverages": _moving("mean", "DMM_"),
    "Ts_distanceFromMovingMins": _moving("min", "DMMI_"),
    "Ts_distanceFromMovingMaxs": _moving("max", "DMMA_"),
    "Ts_lags": Operator(
        "history", offsets=LAG_ROWS, columns=lambda panel, name, out: lag_columns(name), fixed_names=True
    ),
}


def register(name: str, operator: Operator) -> None:
    """Make an operator of your own available to stages under ``name``."""
    if operator.kind in ("row", "history") and operator.columns is None:
        raise ValueError(f"operator {name} of kind {operator.kind} needs columns")
    if operator.kind == "distance" and operator.statistic is None:
        raise ValueError(f"operator {name} needs a statistic")
    unknown = {operator.statistic, operator.unit} - {None, *known_statistics()}
    if unknown:
        raise ValueError(f"operator {name} uses unknown statistics {', '.join(sorted(unknown))}")
    OPERATORS[name] = operator


@dataclass(frozen=True)
class Stage:
    operator: str
    source: str = ""
    prefix: str | None = None


@dataclass(frozen=True)
class Step:
    """A stage applied to one column: input and output names are known."""

    root: str
    operator: Operator = field(repr=False)
    source: str
    out: str

    def expressions(self, panel: Panel) -> dict[str, str | None]:
        """Output names and expressions, None for those that need more than an expression."""
        if self.operator.kind == "keep":
            return {}
        if self.operator.columns is None:
            return {self.out: None}
        return self.operator.columns(panel, self.source, self.out)


Recipe = Sequence[Stage]
Controller = Mapping[str, Recipe]

# The two shipped recipes.
KEEP: Recipe = (Stage("doNothing"),)

FULL: Recipe = (
    Stage("Cs_distanceFromMean"),
    Stage("Cs_distanceFromMin"),
    Stage("Cs_distanceFromMax"),
    Stage("Cs_distanceFromMedian"),
    Stage("Cs_ecdf"),
    Stage("Cs_bucketize", "E_"),
    Stage("Cs_quantile", "E_"),
    Stage("Cs_naiveOutliers", "Q_E_"),
    Stage("Ts_distanceFromMovingAverages"),
    Stage("Ts_distanceFromMovingMins"),
    Stage("Ts_distanceFromMovingMaxs"),
    Stage("Ts_lags"),
    Stage("Ts_lags", "DM_"),
)

# The column names of the shipped input table and the columns of it
# that get the full recipe.
BASE_COLUMNS = (
    "LIMIT_BAL", "SEX", "EDUCATION", "MARRIAGE", "AGE", "PAY_0", "PAY_2", "PAY_3", "PAY_4", "PAY_5",
    "PAY_6", "BILL_AMT1", "BILL_AMT2", "BILL_AMT3", "BILL_AMT4", "BILL_AMT5", "BILL_AMT6",
    "PAY_AMT1", "PAY_AMT2", "PAY_AMT3", "PAY_AMT4", "PAY_AMT5", "PAY_AMT6",
    "default_payment_next_month",
)
FULL_COLUMNS = (
    "LIMIT_BAL", "EDUCATION", "AGE", "PAY_2", "PAY_4", "PAY_6", "BILL_AMT2", "BILL_AMT4",
    "BILL_AMT6", "PAY_AMT2", "PAY_AMT4", "PAY_AMT6", "LIMIT_BAL_1", "EDUCATION_1", "AGE_1",
    "PAY_2_1", "PAY_4_1", "PAY_6_1", "BILL_AMT2_1", "BILL_AMT4_1",
)
CLONES = 11


def shipped_controller() -> dict[str, Recipe]:
    """The controller of the shipped 288-column table: 20 full, the rest kept."""
    names = [*BASE_COLUMNS, *[f"{c}_{i}" for i in range(1, CLONES + 1) for c in BASE_COLUMNS]]
    return {c: FULL if c in FULL_COLUMNS else KEEP for c in names}


def recipe_from_table(table: Mapping[int, Sequence[str]]) -> Recipe:
    """Recipe from ``{stage number: [operator, input prefix or 'root', output prefix]}``.

    Operators that emit fixed names do so whatever the output prefix says.
    """
    stages = []
    for number in sorted(table):
        name, source, prefix = table[number]
        fixed = _operator(name).fixed_names or _operator(name).kind == "keep"
        stages.append(Stage(name, "" if source == "root" else source, None if fixed else prefix))
    return tuple(stages)


def steps_for(root: str, recipe: Recipe) -> list[Step]:
    steps = []
    for stage in recipe:
        operator = _operator(stage.operator)
        source = stage.source + root
        out = operator.default + source if stage.prefix is None else stage.prefix + root
        steps.append(Step(root, operator, root if operator.kind == "keep" else source, out))
    return steps


def _operator(name: str) -> Operator:
    if name not in OPERATORS:
        raise ValueError(f"unknown operator {name}; known: {', '.join(sorted(OPERATORS))}")
    return OPERATORS[name]
