"""From a panel and a controller to one wide feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators.ecdf import add_ecdf
from chronopanel.operators.frozen import FrozenSection, Reference
from chronopanel.operators.history import SLICE, add_earlier, add_slices, hot_entity_cuts
from chronopanel.operators.pieces import CrossSection
from chronopanel.operators.scores import add_normal_scores
from chronopanel.operators.snapshot import add_distances
from chronopanel.panel import Panel, named, quoted
from chronopanel.plans.spec import KEEP, Controller, Recipe, Step, steps_for
from chronopanel.scale import DEFAULT_LIMITS, Limits, stored

PACKED = "__packed"
PACK_FROM = 16
OLDER = "__older"


def generate_features(
    df: DataFrame,
    panel: Panel,
    controller: Controller,
    unlisted: Recipe | None = None,
    limits: Limits = DEFAULT_LIMITS,
    reference: Reference | None = None,
    earlier_rows: DataFrame | None = None,
    same: Mapping[str, str] | None = None,
) -> DataFrame:
    """Keys, then every column followed by its features, as one lazy DataFrame.

    Columns missing from the controller are an error unless ``unlisted`` gives
    their recipe (``KEEP`` passes them through).

    Statistics and ranks of all columns are taken together and come back by one
    lookup and one join; all history features share one window.  ``df`` is read
    several times with different columns, so give a stored table (``stored(df)`` for a
    derived one).  Only a recipe that ranks or averages over derived columns makes
    another round, for which the rows so far are stored.

    With a ``reference`` ranks and distances are taken against that frozen cross-section
    instead of the rows' own snapshots.  ``earlier_rows`` (keys and the inputs of history
    features) precede the rows of ``df`` in the histories and do not come out, see ``plans.store``.

    ``same`` says of columns which other column of ``df`` they equal in every row.  Those that only pass through
    are then not taken along, but written out from that one at the end.
    """
    columns = panel.value_columns(df)
    unknown = [c for c in columns if c not in controller]
    if unknown and unlisted is None:
        raise ValueError(f"no recipe for columns {', '.join(unknown)}")
    steps = [s for c in columns for s in steps_for(c, controller.get(c, unlisted or KEEP))]
    expressions = {id(s): s.expressions(panel) for s in steps}
    pending = [s for s in steps if s.operator.kind != "keep"]
    kinds = {s.operator.kind for s in pending}

    featured = {s.root for s in pending}
    held = _holders(columns, featured, same or {})
    kept = [c for c in dict.fromkeys(held.values()) if c not in featured]
    if len(kept) >= PACK_FROM:
        # Columns that only pass through travel as one value.
        together = f"struct({', '.join(quoted(c) for c in kept)}) AS {PACKED}"
        current = df.selectExpr(*[quoted(c) for c in [*panel.keys, *columns] if c in (*panel.keys, *featured)], together)
    else:
        current = df.selectExpr(*[quoted(c) for c in [*panel.keys, *columns] if c in (*panel.keys, *featured, *kept)])
        kept = []
    def section(rows: DataFrame) -> CrossSection:
        return CrossSection(rows, panel, limits) if reference is None else FrozenSection(rows, panel, reference, limits)

    cross = section(current)
    cuts = None
    if "history" in kinds:
        cuts = hot_entity_cuts(current, panel, cross.sizes.groups if kinds & {"distance", "rank"} else None, limits)
        if cuts is not None:
            current = add_slices(current, panel, cuts)
            cross = section(current)
            if earlier_rows is not None:
                earlier_rows = add_slices(earlier_rows, panel, cuts)
    slices = [SLICE] if cuts is not None else []

    while pending:
        batch = _next_batch(pending, set(current.columns))
        if batch[0].operator.kind in ("rank", "distance") and any(s.source not in cross.df.columns for s in batch):
            current = stored(current)
            cross = section(current)
        match batch[0].operator.kind:
            case "rank":
                ranks = {s.out: s.source for s in batch}
                current = add_ecdf(current, cross, ranks, slices)
            case "distance":
                distances = {s.out: (s.source, s.operator.statistic, s.operator.unit) for s in batch}
                current = add_distances(current, cross, distances)
            case "score":
                current = add_normal_scores(current, {s.out: s.source for s in batch})
            case "row":
                current = current.selectExpr("*", *_items(batch, expressions))
            case "history":
                offsets: dict[str, set[int]] = {}
                for s in batch:
                    offsets.setdefault(s.source, set()).update(s.operator.offsets)
                if earlier_rows is not None:
                    older = earlier_rows.select(*panel.keys, *slices, *offsets, F.lit(True).alias(OLDER))
                    current = current.withColumn(OLDER, F.lit(False)).unionByName(older, allowMissingColumns=True)
                current = add_earlier(current, panel, offsets, limits, cuts)
                current = current.selectExpr("*", *_items(batch, expressions))
                if earlier_rows is not None:
                    current = current.where(~F.col(OLDER)).drop(OLDER)
        pending = [s for s in pending if s not in batch]

    features = {c: [] for c in columns}
    for s in steps:
        features[s.root].extend(expressions[id(s)])
    wide = [*panel.keys, *[name for c in columns for name in [c, *features[c]]]]
    out = {c: held.get(c, c) for c in wide}
    return current.selectExpr(*named({c: f"{PACKED}.{quoted(h)}" if h in kept else quoted(h) for c, h in out.items()}))


def _holders(columns: list[str], featured: set[str], same: Mapping[str, str]) -> dict[str, str]:
    """For every column the one whose values it is written out from: itself, unless it only passes through."""
    unknown = (set(same) | set(same.values())) - set(columns)
    if unknown:
        raise ValueError(f"no columns {', '.join(sorted(unknown))} that could be the same")
    held = {}
    for c in columns:
        seen, holder = {c}, c
        while holder not in featured and same.get(holder, holder) not in seen:
            holder = same[holder]
            seen.add(holder)
        held[c] = holder
    return held


def _items(batch: list[Step], expressions: dict[int, dict[str, str | None]]) -> list[str]:
    return [item for s in batch for item in named(expressions[id(s)])]


def _next_batch(pending: list[Step], present: set[str]) -> list[Step]:
    """Steps of one kind whose inputs are present.

    Ranks and statistics come first.  History waits until all its inputs are there,
    so that one window serves all of it; row-wise steps that nothing waits for come
    last, which keeps the rows narrow while they are sorted.
    """

    def ready(kind: str) -> list[Step]:
        return [s for s in pending if s.operator.kind == kind and s.source in present]

    history = [s for s in pending if s.operator.kind == "history"]
    for batch in (ready("rank"), ready("distance")):
        if batch:
            return batch
    if history and len(ready("history")) == len(history):
        return history
    for batch in (ready("score"), ready("row"), ready("history")):
        if batch:
            return batch
    raise ValueError(f"no column {', '.join(sorted({s.source for s in pending}))} to derive features from")


def merge_features(container: DataFrame, block: DataFrame, panel: Panel) -> DataFrame:
    """Left join of a separately computed feature block to a container by the keys.

    Raises if the block has a key twice, which would multiply rows.  The block is stored
    first, so the check does not compute it again.
    """
    block = stored(block)
    keys = [quoted(k) for k in panel.keys]
    repeated = block.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).count()
    if repeated:
        raise ValueError("the feature block holds a key more than once")
    clash = (set(container.columns) & set(block.columns)) - set(panel.keys)
    if clash:
        raise ValueError(f"both tables have columns {', '.join(sorted(clash))}")
    return container.join(block, panel.keys, "left")


def merge_stored(spark: SparkSession, container: str, blocks: Sequence[str], panel: Panel) -> DataFrame:
    """Left join of feature blocks to a container, all of them tables written by ``save_by_entity``: no row is shuffled.

    Every bucket is merged by itself, and so is the check that a block has no key twice, which raises.  Tables that are not
    bucketed by the entity, or into different numbers of buckets, raise, since their rows would have to move.
    Needs the session settings of ``configure``.
    """
    buckets = {name: _buckets(spark, name) for name in (container, *blocks)}
    wrong = [name for name, found in buckets.items() if found[1] != [panel.entity] or found != buckets[container]]
    if wrong:
        raise ValueError(f"not in {buckets[container][0]} buckets by {panel.entity}: {', '.join(wrong)}")
    merged, keys = spark.table(container), [quoted(k) for k in panel.keys]
    for name in blocks:
        block = spark.table(name)
        clash = (set(merged.columns) & set(block.columns)) - set(panel.keys)
        if clash:
            raise ValueError(f"both tables have columns {', '.join(sorted(clash))}")
        repeated = block.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        if not repeated.isEmpty():
            raise ValueError(f"{name} holds a key more than once")
        merged = merged.join(block.hint("merge"), panel.keys, "left")
    return merged


def _buckets(spark: SparkSession, table: str) -> tuple[str | None, list[str]]:
    """Number of buckets and the columns they are by."""
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
    return described.get("Num Buckets"), [c.strip("` ") for c in described.get("Bucket Columns", "[]").strip("[]").split(",")]
