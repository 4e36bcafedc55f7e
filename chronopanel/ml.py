"""Recipes and operators as ``pyspark.ml`` transformers, to mix with other ML stages.

``PanelRecipe`` runs a whole recipe for one column through ``generate_features``, so its
stages share the scans, the joins and the window; ``PanelStage`` is a single operator.
Neither joins the rows to features computed apart.

``FrozenPanel`` is an estimator: fitted on a panel it keeps its cross-section, and the model takes ranks and
distances of other rows against that, as a scoring job must that sees one new snapshot at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators.frozen import Reference, freeze
from chronopanel.panel import Panel, quoted
from chronopanel.plans.generate import generate_features
from chronopanel.plans.spec import KEEP, Recipe, Stage, steps_for
from chronopanel.scale import new_path


class PanelStage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the columns of one operator for ``inputCol``.

    ``outputCol`` names the output of operators with a single one, and the stem of
    the moving distances; the others derive their names from the input.
    """

    operator = Param(Params._dummy(), "operator", "name of the operator", TypeConverters.toString)
    entityCol = Param(Params._dummy(), "entityCol", "entity key", TypeConverters.toString)
    snapshotCol = Param(Params._dummy(), "snapshotCol", "snapshot key", TypeConverters.toString)
    exactScale = Param(Params._dummy(), "exactScale", "decimal places for exact sums, -1 for plain doubles", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, operator=None, inputCol=None, outputCol=None, entityCol="ID", snapshotCol="snapshotDate", exactScale=-1):
        super().__init__()
        self._setDefault(entityCol="ID", snapshotCol="snapshotDate", exactScale=-1)
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, operator=None, inputCol=None, outputCol=None, entityCol="ID", snapshotCol="snapshotDate", exactScale=-1):
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        column, stage = self.getInputCol(), Stage(self.getOrDefault(self.operator))
        (step,) = steps_for(column, [stage])
        return _featured(dataset, _panel(self), column, [stage], lambda name: self._renamed(name, step.out))

    def _renamed(self, name: str, stem: str) -> str:
        if self.isSet(self.outputCol) and name.startswith(stem) and stem:
            return self.getOutputCol() + name[len(stem) :]
        return name


class PanelRecipe(Transformer, HasInputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds all columns of a recipe for ``inputCol``.

    ``recipe`` has a JSON list of operator, source prefix and output prefix per stage.
    """

    recipe = Param(Params._dummy(), "recipe", "stages as JSON lists", TypeConverters.toListString)
    entityCol = Param(Params._dummy(), "entityCol", "entity key", TypeConverters.toString)
    snapshotCol = Param(Params._dummy(), "snapshotCol", "snapshot key", TypeConverters.toString)
    exactScale = Param(Params._dummy(), "exactScale", "decimal places for exact sums, -1 for plain doubles", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, recipe=None, inputCol=None, entityCol="ID", snapshotCol="snapshotDate", exactScale=-1):
        super().__init__()
        self._setDefault(entityCol="ID", snapshotCol="snapshotDate", exactScale=-1)
        self.setParams(**self._input_kwargs)

    @keyword_only
    def setParams(self, *, recipe=None, inputCol=None, entityCol="ID", snapshotCol="snapshotDate", exactScale=-1):
        return self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        stages = [Stage(*json.loads(text)) for text in self.getOrDefault(self.recipe)]
        return _featured(dataset, _panel(self), self.getInputCol(), stages, lambda name: name)


class _FrozenParams(HasInputCols):
    """What estimator and model share."""

    recipe = Param(Params._dummy(), "recipe", "stages as JSON lists, the same for all columns", TypeConverters.toListString)
    entityCol = Param(Params._dummy(), "entityCol", "entity key", TypeConverters.toString)
    snapshotCol = Param(Params._dummy(), "snapshotCol", "snapshot key", TypeConverters.toString)
    exactScale = Param(Params._dummy(), "exactScale", "decimal places for exact sums, -1 for plain doubles", TypeConverters.toInt)
    path = Param(Params._dummy(), "path", "folder of the frozen cross-section", TypeConverters.toString)

    def _stages(self) -> list[Stage]:
        return [Stage(*json.loads(text)) for text in self.getOrDefault(self.recipe)]


class FrozenPanel(Estimator, _FrozenParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the cross-section of the panel it is fitted on, in ``path`` (default: a new folder under the checkpoint folder).

    Ranks and distances of the recipe must be of the input columns themselves.
    """

    @keyword_only
    def __init__(self, *, recipe=None, inputCols=None, entityCol="ID", snapshotCol="snapshotDate", exactScale=-1, path=None):
        super().__init__()
        self._setDefault(entityCol="ID", snapshotCol="snapshotDate", exactScale=-1)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FrozenPanelModel:
        path = self.getOrDefault(self.path) if self.isSet(self.path) else new_path(dataset.sparkSession, "reference")
        freeze(dataset, _panel(self), self.getInputCols()).save(path)
        return self._copyValues(FrozenPanelModel())._set(path=path)


class FrozenPanelModel(Model, _FrozenParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the recipe's columns for every input column, ranked and measured against the frozen cross-section."""

    def __init__(self):
        super().__init__()
        self._setDefault(entityCol="ID", snapshotCol="snapshotDate", exactScale=-1)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        reference = Reference.load(dataset.sparkSession, self.getOrDefault(self.path))
        controller = {c: self._stages() for c in self.getInputCols()}
        wide = generate_features(dataset, _panel(self), controller, unlisted=KEEP, reference=reference)
        made = [c for c in wide.columns if c not in dataset.columns]
        return wide.select(*[quoted(c) for c in dataset.columns], *[quoted(c) for c in made])


def _panel(stage: PanelStage | PanelRecipe | _FrozenParams) -> Panel:
    scale = stage.getOrDefault(stage.exactScale)
    return Panel(stage.getOrDefault(stage.entityCol), stage.getOrDefault(stage.snapshotCol), None if scale < 0 else scale)


def _featured(dataset: DataFrame, panel: Panel, column: str, recipe: Recipe, name: Callable[[str], str]) -> DataFrame:
    """``dataset`` with the columns ``recipe`` makes of ``column`` after its own."""
    wide = generate_features(dataset, panel, {column: recipe}, unlisted=KEEP)
    made = [c for c in wide.columns if c not in dataset.columns]
    return wide.select(*[quoted(c) for c in dataset.columns], *[F.col(quoted(c)).alias(name(c)) for c in made])


def as_json(recipe: Recipe) -> list[str]:
    """Stages as the ``recipe`` parameters take them."""
    return [json.dumps([s.operator, s.source, s.prefix]) for s in recipe]


def transformers_for(column: str, recipe: Recipe, panel: Panel) -> Pipeline:
    """A recipe for one column as an ML Pipeline."""
    stages = as_json(recipe)
    scale = -1 if panel.exact_scale is None else panel.exact_scale
    recipe_stage = PanelRecipe(
        recipe=stages, inputCol=column, entityCol=panel.entity, snapshotCol=panel.snapshot, exactScale=scale
    )
    return Pipeline(stages=[recipe_stage])
