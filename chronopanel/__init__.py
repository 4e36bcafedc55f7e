"""Panel feature generation on Spark DataFrames."""

from chronopanel.panel import Panel, check_keys
from chronopanel.plans.generate import generate_features, merge_features
from chronopanel.plans.spec import FULL, KEEP, Operator, Stage, recipe_from_table, register, shipped_controller
from chronopanel.scale import Limits, configure, pin, stored

__all__ = [
    "FULL",
    "KEEP",
    "Limits",
    "Operator",
    "Panel",
    "Stage",
    "check_keys",
    "configure",
    "generate_features",
    "merge_features",
    "pin",
    "recipe_from_table",
    "register",
    "shipped_controller",
    "stored",
]
