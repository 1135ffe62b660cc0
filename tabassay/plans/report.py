"""Text reports; every frame that is collected here has a few rows for each method, metric and profile."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabassay.constants import CORE_METRICS, METHOD_LABELS, OBJECTIVES, PROFILE_NAMES, PROFILES
from tabassay.plans import decision as D
from tabassay.plans import simulation as V
from tabassay.plans import statistics as S

RULE = "=" * 70


def _label(method: str) -> str:
    return METHOD_LABELS.get(method, method)


def _number(x: float | None, form: str = ".4f") -> str:
    return "n/a" if x is None else format(x, form)


#: The least normalised value that each word stands for.
STRENGTHS = {"strong": 0.7, "moderate": 0.4, "weak": 0.0}


def _strength(value: float) -> str:
    return next(word for word, least in STRENGTHS.items() if value > least or word == "weak")


def recommendation(results: DataFrame, weights: dict[str, float], profile_name: str = "Custom") -> str:
    """Who leads under one set of weights and by how much, what every method gets from each objective, and where the leader stands.

    Any number of methods. A cell of the table is the objective's part of the score: its weight times the normalised value.
    """
    D.check_weights(weights)
    normal = D.normalize(D.method_scores(results)).cache()
    ranked = D.rank_methods(D.weighted(normal, D.profile_table(results.sparkSession, {"p": weights}))).orderBy("rank", "method").collect()
    values = {(r["method"], OBJECTIVES[r["metric"]]): r["value"] for r in normal.filter(normal.metric.isin(*OBJECTIVES)).collect()}
    normal.unpersist()
    if not ranked:
        return f"RECOMMENDATION ({profile_name}): none, as there are no results."
    leader, *others = ranked
    lead = f", {_number(leader['score'] - others[0]['score'])} ahead of {_label(others[0]['method'])}" if others else ", the only method"
    objectives = sorted(weights, key=lambda o: (-weights[o], o))
    table = [["", "method", "score", *[f"{o} {weights[o]:.0%}" for o in objectives]]]
    for r in ranked:
        parts = [values.get((r["method"], o)) for o in objectives]
        table.append([str(r["rank"]), _label(r["method"]), _number(r["score"]), *[_number(None if v is None else v * weights[o], ".3f") for o, v in zip(objectives, parts, strict=True)]])
    widths = [max(map(len, column)) for column in zip(*table, strict=True)]
    rows = ["  ".join(cell.ljust(w) if i < 2 else cell.rjust(w) for i, (cell, w) in enumerate(zip(row, widths, strict=True))).rstrip() for row in table]
    own = {o: values[leader["method"], o] for o in OBJECTIVES.values() if values.get((leader["method"], o)) is not None}
    stands = [f"{_label(leader['method'])} is {word} in " + ", ".join(f"{o} ({v:.2f})" for o, v in own.items() if _strength(v) == word) + "." for word in STRENGTHS if any(_strength(v) == word for v in own.values())]
    return "\n".join([f"RECOMMENDATION ({profile_name}): {_label(leader['method'])}{lead}", "", *rows, "", *stands])


def all_profiles(results: DataFrame) -> str:
    """The recommendation of every profile, and a table of the leaders."""
    ranked = D.recommend(results).cache()
    lead = {r["profile"]: r for r in D.leaders(ranked).collect()}
    lines = [recommendation(results, w, PROFILE_NAMES[p]) for p, w in PROFILES.items()]
    lines += ["", "LEADERS"] + [f"  {PROFILE_NAMES[p]:<30} {_label(lead[p]['leader'])} (+{_number(lead[p]['advantage'])})" for p in PROFILES if p in lead]
    return "\n".join(lines)


def statistics(results: DataFrame) -> str:
    """Descriptive statistics, assumptions, omnibus and pairwise tests, middle tier, correlations, data quality."""
    n = results.count()
    lines = [RULE, "STATISTICAL ANALYSIS REPORT", f"{n} results, {results.select('method').distinct().count()} methods", RULE]
    descr = S.descriptive(results).orderBy("metric", "mean").collect()
    lines += ["", "1. DESCRIPTIVE STATISTICS"]
    lines += [f"  {r['metric']:<13} {_label(r['method']):<18} n={r['n']} mean={_number(r['mean'])} sd={_number(r['std'])} 95% CI [{_number(r['ci_lower'])}, {_number(r['ci_upper'])}]" for r in descr]
    lines += ["", "2. ASSUMPTIONS"]
    lines += [f"  Shapiro-Wilk {r['metric']:<13} {_label(r['method']):<18} W={r['statistic']:.4f} p={r['p_value']:.4f}" for r in S.normality(results).orderBy("metric", "method").collect()]
    lines += [f"  Levene {r['metric']:<13} W={_number(r['statistic'], '.3f')} p={_number(r['p_value'])}" for r in S.levene(results).orderBy("metric").collect()]
    lines += ["", "3. OMNIBUS TESTS"]
    lines += [
        f"  {r['metric']:<13} F={_number(r['anova_f'], '.3f')} (p={_number(r['anova_p'], '.2e')}) H={_number(r['kruskal_h'], '.3f')} (p={_number(r['kruskal_p'], '.2e')}) eta^2={_number(r['eta_squared'])} ({r['effect']})"
        for r in S.omnibus(results).orderBy("metric").collect()
    ]
    show = lambda r: f"  {r['metric']:<13} {_label(r['method_1'])} - {_label(r['method_2'])}: t={_number(r['t'], '.3f')} p={_number(r['t_p'])} U={r['u']:.1f} p={_number(r['mw_p'])} d={r['cohens_d']:.3f} ({r['effect']})"
    lines += ["", "4. PAIRWISE COMPARISONS"] + [show(r) for r in S.pairwise(results).orderBy("metric", "method_1", "method_2").collect()]
    corr = lambda df: [f"  {r['metric_1']} / {r['metric_2']}: rho={_number(r['spearman'], '.3f')} r={_number(r['pearson'], '.3f')} n={r['n']}" for r in df.orderBy("metric_1", "metric_2").collect()]
    means = S.mean_correlations(results).cache()
    warned = [f"{r['metric_1']} / {r['metric_2']}" for r in means.filter("high_correlation").collect()]
    lines += ["", "5. CORRELATIONS OF METHOD MEANS", *corr(means), f"  Independence: {'valid' if not warned else 'doubtful for ' + ', '.join(sorted(warned))}"]
    lines += ["", "5a. CORRELATIONS OF REPLICATES", *corr(S.replicate_correlations(results))]
    pairs, counts = S.middle_tier(results)
    lines += ["", "5b. MIDDLE-TIER METHODS"] + [show(r) for r in pairs.orderBy("metric", "method_1", "method_2").collect()]
    apart = counts.filter("any_significant").take(1)
    lines.append("  At least one pair can be told apart on a metric." if apart else "  No pair differs significantly after correction.")
    issues = S.quality_issues(results).collect()
    lines += ["", "6. DATA QUALITY"] + ([f"  {r['type']}: {r['method'] or ''} {r['column_name']} ({r['count']})" for r in issues] or ["  No issues found."])
    return "\n".join([*lines, RULE])


def analysis(results: DataFrame) -> tuple[str, dict[str, DataFrame]]:
    """The report and the nine frames behind it."""
    pairs, counts = S.middle_tier(results)
    frames = {
        "descriptive": S.descriptive(results), "normality": S.normality(results), "levene": S.levene(results), "omnibus": S.omnibus(results), "pairwise": S.pairwise(results),
        "correlations": S.mean_correlations(results), "replicate_correlations": S.replicate_correlations(results), "middle_tier": pairs, "quality": S.quality_issues(results),
    }
    return statistics(results), frames


_VOI_ROWS = (("s1_random", "Random choice"), ("s2_heuristic", "Rule of thumb"), ("s2_informed", "Informed rule"), ("s3_rough", "Rough estimates"), ("s4_benchmark", "Full benchmark"), ("oracle", "Oracle"))


def value_of_information(results: DataFrame, n_simulations: int = 50_000) -> str:
    rows = {r["archetype"]: r for r in V.value_of_information(results, n_simulations).collect()}
    names = [p for p in PROFILES if p in rows]
    lines = [RULE, "VALUE OF INFORMATION", RULE, f"{'Strategy':<20}" + "".join(f"{PROFILE_NAMES[p]:>30}" for p in names)]
    lines += [f"{label:<20}" + "".join(f"{rows[p][k]:>30.3f}" for p in names) for k, label in _VOI_ROWS]
    lines += [f"{'% prioritization':<20}" + "".join(f"{rows[p]['pct_from_prioritization']:>30.0f}" for p in names)]
    lines += [f"{'% information':<20}" + "".join(f"{rows[p]['pct_from_information']:>30.0f}" for p in names), RULE]
    return "\n".join(lines)


def inflation(results: DataFrame, n_simulations: int = 10_000) -> str:
    """The value of information at each inflation factor, and whether its main finding holds at all of them."""
    sweep = V.inflation_sensitivity(results, n_simulations=n_simulations).cache()
    rows, end = sweep.orderBy("factor").collect(), V.inflation_verdict(sweep).first()
    sweep.unpersist()
    lines = ["UNCERTAINTY INFLATION", f"{'factor':>8}{'% prioritization':>18}{'% information':>15}{'oracle':>10}{'gap':>10}"]
    lines += [f"{r['factor']:>8.2f}{r['mean_pct_prioritization']:>18.1f}{r['mean_pct_information']:>15.1f}{_number(r['mean_oracle']):>10}{_number(r['mean_evpi_gap']):>10}" for r in rows]
    if end["verdict"]:
        lines.append(f"Prioritization brings {end['least_pct']:.0f}% to {end['greatest_pct']:.0f}% of the value; that it is the greater part is {end['verdict']} to the factor.")
    return "\n".join(lines)


def overview(results: DataFrame) -> str:
    """A first look for a newcomer: mean scores, their normalised values, every profile's leader, and the balanced recommendation."""
    scores = D.method_scores(results).cache()
    parts = [("MEAN SCORES (time in minutes)", {(r["method"], r["metric"]): r["mean"] for r in scores.collect()})]
    parts.append(("NORMALISED, 1 IS BEST", {(r["method"], r["metric"]): r["value"] for r in D.normalize(scores).collect()}))
    lines: list[str] = []
    for title, cells in parts:
        metrics = [m for m in OBJECTIVES if any(m == k[1] for k in cells)]
        lines += [title, f"{'':<24}" + "".join(f"{m:>18}" for m in metrics)]
        lines += [f"{_label(method):<24}" + "".join(f"{_number(cells.get((method, m))):>18}" for m in metrics) for method in sorted({k[0] for k in cells})]
        lines.append("")
    scores.unpersist()
    return "\n".join([*lines, all_profiles(results)])


def latex_table(frame: DataFrame, columns: list[str], caption: str) -> str:
    """A small frame as a LaTeX table; numbers with three decimals."""
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    body = [" & ".join(cell(r[c]) for c in columns) + r" \\" for r in frame.select(*columns).collect()]
    head = " & ".join(c.replace("_", r"\_") for c in columns) + r" \\"
    return "\n".join([r"\begin{table}[ht]", r"\centering", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{l{'r' * (len(columns) - 1)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}", r"\end{table}"])


def voi_latex(results: DataFrame, n_simulations: int = 50_000) -> str:
    v = V.value_of_information(results, n_simulations).cache()
    one = latex_table(v, ["archetype", *(k for k, _ in _VOI_ROWS)], "Value of each strategy")
    return one + "\n\n" + latex_table(v, ["archetype", "value_of_prioritization", "value_of_information", "pct_from_prioritization", "pct_from_information"], "Where the improvement comes from")


def verification(results: DataFrame) -> str:
    """Published claims against the results: three expected means, weighted rankings, methods whose utility exceeds 1."""
    means = {r["method"]: r for r in D.wide_means(results).collect()}
    lines = [RULE, "CLAIM VERIFICATION", RULE, "", "Method means"]
    lines += [f"  {_label(m):<18} " + " ".join(f"{k}={_number(r[k])}" for k in CORE_METRICS) for m, r in sorted(means.items())]
    lines += ["", "Expected values"]
    for method, metric, want in (("synthpop", "fidelity_auc", 0.484), ("synthpop", "utility_tstr", 1.0), ("independent_marginals", "privacy_dcr", 0.14)):
        got = means[method][metric] if method in means else None
        verdict = "SKIPPED (method absent)" if got is None else "PASS" if abs(got - want) < 0.01 else "FAIL"
        lines.append(f"  {_label(method)} {metric}: expected {want}, found {_number(got)}: {verdict}")
    for p in PROFILES:
        lines += ["", f"Weighted scores, {PROFILE_NAMES[p]}"]
        values = V.method_values(results, {p: PROFILES[p]}).orderBy("value", ascending=False).collect()
        lines += [f"  {i + 1}. {_label(r['method']):<18} {r['value']:.4f}" for i, r in enumerate(values)]
    best = sorted(means.values(), key=lambda r: -(r["utility_tstr"] or 0))
    above = sum((r["utility_tstr"] or 0) > 1 for r in means.values())
    lines += ["", "Utility ranking: " + ", ".join(_label(r["method"]) for r in best), f"Methods with utility above 1: {above}/{len(means)}", RULE]
    return "\n".join(lines)
