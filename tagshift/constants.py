"""Fixed values of the analysis: scales, fractions, cuts, binnings and method ids."""

from __future__ import annotations

import math

# --- fixed values -----------------------------------------------------------
PI_4B_LARGE = 0.0998996846167015  # scale of the up-sampled 4b sample
SIGNAL_SCALE = 100.0
SIGNAL_FRACTION = {"SB": 1.1 / 10420, "CR": 1.8 / 7553, "SR": 3.8 / 7134}
TOTAL_EVENTS_SR = 7134.0

HIGGS_MASS = 125.0
Z_MASS = 91.0

MIN_JET_PT = 40.0
MAX_JET_ETA = 2.5
MAX_SELECTED_ETA = 2.4
OTHER_JET_SLOTS = 12

BASE_RADIUS = 2 * math.pi  # R0 of the event distance
KNN_RADIUS = 2.75
COUPLING_RADIUS = 0.4
HALF_STEPS = 35  # the sT range is cut into this many steps, two per block
BLOCK_TARGETS = 8895  # SR events per transport block

METHOD_IDS = {
    "fvt": "HH_FvT__cl_np799_l0_01_e10",
    "comb": "HH_Comb_FvT__pl_emd_p1_R0_4__cl_np799_l0_01_e10",
    "ot1": "HH_OT__pl_emd_p1_R0_4__K_1",
    "ot5": "HH_OT__pl_emd_p1_R0_4__K_5",
    "ot10": "HH_OT__pl_emd_p1_R0_4__K_10",
    "ot20": "HH_OT__pl_emd_p1_R0_4__K_20",
    "benchmark": "benchmark",
}

MASS_EDGES = [
    200, 210, 220, 231, 242, 254, 266, 279, 292, 306, 321, 337, 353, 370, 388, 407, 427,
    448, 470, 493, 517, 542, 569, 597, 626, 657, 689, 723, 759, 796, 835, 876, 919, 1000,
]

# variable name -> (SQL expression over the event table, binning); a binning is either a list
# of edges or (number of bins, low, high)
HISTOGRAM_VARIABLES = {
    "m4j": ("m4j", MASS_EDGES),
    "mHH": ("mHH", MASS_EDGES),
    "dRjjClose": ("dRjjClose", (25, 0.0, 2.5)),
    "dRjjOther": ("dRjjOther", (40, 0.0, 4.0)),
    "aveAbsEta": ("aveAbsEta", (25, 0.0, 2.5)),
    "jetPt0": ("jets[0].pt", (32, 40.0, 200.0)),
    "jetPt1": ("jets[1].pt", (32, 40.0, 200.0)),
    "jetPt2": ("jets[2].pt", (32, 40.0, 200.0)),
    "jetPt3": ("jets[3].pt", (32, 40.0, 200.0)),
    "jetEnergy0": ("jets[0].e", (100, 0.0, 800.0)),
    "jetEnergy1": ("jets[1].e", (100, 0.0, 800.0)),
    "jetEnergy2": ("jets[2].e", (100, 0.0, 800.0)),
    "jetEnergy3": ("jets[3].e", (100, 0.0, 800.0)),
    "sT": ("jets[0].pt + jets[1].pt + jets[2].pt + jets[3].pt", (40, 150.0, 550.0)),
    "SvB": ("svb", (30, 0.0, 1.0)),
    "FvT": ("h", (30, 0.0, 1.0)),
}
MASS_PLANE_BINS = (70, 70.0, 190.0)

JET_ORDER = "012302130312"  # jets in the order that makes neighbouring slots a dijet
# mean and width used in place of measured ones when features are standardised
SCALER_OVERRIDES = {
    "eta": (0.0, 2.4),
    "phi": (0.0, math.pi),
    "dijet_mass": (130.0, 100.0),
    "dijet_dr": (math.pi / 2, math.pi / 2),
    "quadjet_dr": (math.pi, math.pi / 2),
}
# ----------------------------------------------------------------------------


def method_name(family: str, transport_id: str = "", classifier_id: str = "", k: int | None = None) -> str:
    """Name of a model's weight column; unknown families keep their own name."""
    parts = {
        "OT": ["HH_OT", f"pl_{transport_id}", f"K_{k}"],
        "FvT": ["HH_FvT", f"cl_{classifier_id}"],
        "RF": ["HH_RF", f"cl_{classifier_id}"],
        "Comb-FvT": ["HH_Comb_FvT", f"pl_{transport_id}", f"cl_{classifier_id}"],
        "Comb-RF": ["HH_Comb_RF", f"pl_{transport_id}", f"cl_{classifier_id}"],
    }
    return "__".join(parts.get(family, [family]))
