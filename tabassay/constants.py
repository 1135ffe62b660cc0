"""Names, weights and reference points of the decision model."""

from __future__ import annotations

# Methods, labels, runtimes, objectives, directions, weights and seeds of the published experiment.
METHODS = ("independent_marginals", "ctgan", "dpbn", "synthpop", "great")
METHOD_LABELS = {
    "independent_marginals": "Indep. Marginals",
    "ctgan": "CTGAN",
    "dpbn": "DP-BN (PrivBayes)",
    "synthpop": "Synthpop",
    "great": "GReaT",
}
RUNTIME_MINUTES = {"independent_marginals": 0.5, "ctgan": 1.0, "dpbn": 0.5, "synthpop": 0.5, "great": 90.0}
EFFICIENCY_TABLE = {"independent_marginals": 1.0, "ctgan": 0.90, "dpbn": 1.0, "synthpop": 1.0, "great": 0.24}
OBJECTIVES = {
    "fidelity_auc": "fidelity",
    "privacy_dcr": "privacy",
    "utility_tstr": "utility",
    "fairness_gap": "fairness",
    "efficiency_time": "efficiency",
}
HIGHER_IS_BETTER = {"fidelity_auc": False, "privacy_dcr": True, "utility_tstr": True, "fairness_gap": False, "efficiency_time": False}
CORE_METRICS = ("fidelity_auc", "privacy_dcr", "utility_tstr", "fairness_gap")
PROFILES = {
    "privacy_first": {"fidelity": 0.25, "privacy": 0.45, "utility": 0.15, "fairness": 0.10, "efficiency": 0.05},
    "utility_first": {"fidelity": 0.30, "privacy": 0.10, "utility": 0.40, "fairness": 0.10, "efficiency": 0.10},
    "balanced": {"fidelity": 0.25, "privacy": 0.25, "utility": 0.25, "fairness": 0.15, "efficiency": 0.10},
}
PROFILE_NAMES = {
    "privacy_first": "Privacy-First Practitioner",
    "utility_first": "Utility-First Practitioner",
    "balanced": "Balanced Practitioner",
}
HEURISTIC = {"privacy_first": "dpbn", "utility_first": "ctgan", "balanced": "great"}
HEURISTIC_INFORMED = {"privacy_first": "dpbn", "utility_first": "synthpop", "balanced": "synthpop"}
REFERENCE_POINTS = {
    "fidelity": {"x_worst": 0.880, "x_best": 0.50},
    "privacy": {"x_worst": 0.007, "x_best": 0.140},
    "utility": {"x_worst": 0.037, "x_best": 1.0},
    "fairness": {"x_worst": 0.080, "x_best": 0.0},
    "efficiency": {"x_best": 0.5, "x_ceiling": 480.0},
}
SEEDS = (42, 123, 456, 789, 1011)
EXPECTED_CORRELATIONS = {
    ("fidelity_auc", "utility_tstr"): (0.4, 0.8),
    ("fidelity_auc", "privacy_dcr"): (-0.6, -0.2),
    ("utility_tstr", "privacy_dcr"): (-0.7, -0.3),
    ("fidelity_auc", "fairness_gap"): (-0.1, 0.5),
}
