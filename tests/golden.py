"""The 25 published results (fixed values): method, replicate, fidelity_auc, privacy_dcr, utility_tstr, fairness_gap."""

import csv
from pathlib import Path

COLUMNS = "method string, replicate int, fidelity_auc double, privacy_dcr double, utility_tstr double, fairness_gap double"


def rows() -> list[tuple]:
    with Path(__file__).with_name("golden.csv").open() as f:
        return [(m, int(r), *map(float, x)) for m, r, *x in list(csv.reader(f))[1:]]
