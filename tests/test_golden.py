"""The nine-row panel whose features were worked out by hand."""

import datetime as dt
from math import inf

import pytest
from chronopanel import FULL, generate_features
from conftest import TINY

from chronopanel.scale import DEFAULT_LIMITS

COLUMNS = (
    "x DM_x DMI_x DMA_x DME_x E_x B4_E_x B10_E_x Q_E_x 2SDU_Q_E_x 3SDU_Q_E_x 2SDD_Q_E_x 3SDD_Q_E_x "
    "DMM_x_2 DMMI_x_2 DMMA_x_2 L1_x L1_DM_x"
).split()
N = None
EXPECTED = {
    ("a", 1, 1): (1, -1.333333, 0, -2, -2, 0.333333, 2, 4, -0.430727, 0, 0, 0, 0, 0, 0, 0, N, N),
    ("a", 1, 31): (2, -1.5, 0, -3, -1.5, 0.333333, 2, 4, -0.430727, 0, 0, 0, 0, 0.5, 1, 0, 1, -1.333333),
    ("a", 3, 2): (4, 0, 0, 0, 0, 1, 5, 11, inf, 1, 1, 0, 0, 1.666667, 3, 0, 2, -1.5),
    ("b", 1, 1): (3, 0.666667, 2, 0, 0, 1, 5, 11, inf, 1, 1, 0, 0, 0, 0, 0, N, N),
    ("b", 1, 31): (N, N, N, N, N, 0, 1, 1, -inf, 0, 0, 1, 1, N, N, N, 3, 0.666667),
    ("b", 3, 2): (4, 0, 0, 0, 0, 1, 5, 11, inf, 1, 1, 0, 0, 0.5, 1, 0, N, N),
    ("c", 1, 1): (3, 0.666667, 2, 0, 0, 1, 5, 11, inf, 1, 1, 0, 0, 0, 0, 0, N, N),
    ("c", 1, 31): (5, 1.5, 3, 0, 1.5, 0.666667, 3, 7, 0.430727, 0, 0, 0, 0, 1, 2, 0, 3, 0.666667),
    ("d", 4, 1): (7, 0, 0, 0, 0, 1, 5, 11, inf, 1, 1, 0, 0, 0, 0, 0, N, N),
}


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, TINY], ids=["plain", "hot"])
def test_golden_panel(golden, panel, limits):
    rows = generate_features(golden, panel, {"x": FULL}, limits=limits).collect()
    assert len(rows) == 9
    for row in rows:
        want = EXPECTED[row["ID"], row["t"].month, row["t"].day]
        got = tuple(row[c] for c in COLUMNS)
        assert got == tuple(w if w is None else pytest.approx(w, abs=1e-6) for w in want), row


def test_output_columns(golden, panel):
    out = generate_features(golden, panel, {"x": FULL})
    assert out.columns[:3] == ["t", "ID", "x"]
    assert len(out.columns) == 3 + 29
