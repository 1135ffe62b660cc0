"""SQL twins of the queries, for an ordinary SQL engine over the same tables."""

from __future__ import annotations

from itertools import combinations

from tabassay.constants import CORE_METRICS, EFFICIENCY_TABLE, EXPECTED_CORRELATIONS, HEURISTIC, HEURISTIC_INFORMED, METHODS, OBJECTIVES, PROFILES, REFERENCE_POINTS, RUNTIME_MINUTES

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: Draws of the Monte-Carlo ranking and of the sweep over inflation factors, and of the value of information.
SIMULATIONS, VOI_SIMULATIONS = 10_000, 50_000


def _case(column: str, table: dict, default: str = "NULL") -> str:
    text = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}e0" if v is not None else "NULL"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _uniform(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::UBIGINT / 4294967296e0)"


def _normal(*parts: str) -> str:
    return f"(sqrt(-2e0 * ln(greatest({_uniform(*parts, chr(39) + 'a' + chr(39))}, 1e-12))) * cos(2e0 * pi() * {_uniform(*parts, chr(39) + 'b' + chr(39))}))"


RESULTS = f"""results AS (
  SELECT {_case("o_orderpriority", dict(zip(PRIORITIES, METHODS, strict=True)))} AS method, CAST(o_orderkey % 5 AS INT) + 1 AS replicate,
         avg(l_discount) * 10e0 AS fidelity_auc, avg(l_tax) AS privacy_dcr, avg(l_quantity) / 50e0 AS utility_tstr,
         abs(avg(CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END) - 1e0 / 3e0) AS fairness_gap
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""
FLAWED = """flawed AS (SELECT method, replicate, fidelity_auc, privacy_dcr, CASE WHEN method = 'dpbn' THEN 0.5e0 ELSE utility_tstr END AS utility_tstr,
  CASE WHEN replicate <> 2 THEN fairness_gap END AS fairness_gap FROM results)"""
EFFICIENT = f"efficient AS (SELECT *, {_case('method', RUNTIME_MINUTES)} AS efficiency_time FROM results)"
LONG = "long AS (UNPIVOT (SELECT method, fidelity_auc, privacy_dcr, utility_tstr, fairness_gap FROM results) ON fidelity_auc, privacy_dcr, utility_tstr, fairness_gap INTO NAME metric VALUE value)"
LONG5 = "long5 AS (UNPIVOT (SELECT method, fidelity_auc, privacy_dcr, utility_tstr, fairness_gap, efficiency_time FROM efficient) ON fidelity_auc, privacy_dcr, utility_tstr, fairness_gap, efficiency_time INTO NAME metric VALUE value)"
SCORES = "scores AS (SELECT method, metric, avg(value) AS mean FROM long5 GROUP BY 1, 2)"
HIGHER = "metric IN ('privacy_dcr', 'utility_tstr')"
NORMAL = f"""ranges AS (SELECT metric, min(mean) AS lo, max(mean) AS hi, avg(mean) AS m, stddev_samp(mean) AS s FROM scores GROUP BY 1),
normal AS (SELECT method, metric, {_case("metric", OBJECTIVES)} AS objective, CASE WHEN {HIGHER} THEN v ELSE 1e0 - v END AS value
  FROM (SELECT method, metric, CASE WHEN hi > lo THEN (mean - lo) / (hi - lo) ELSE 0.5e0 END AS v FROM scores JOIN ranges USING (metric)))"""
ZNORMAL = f"""ranges AS (SELECT metric, min(mean) AS lo, max(mean) AS hi, avg(mean) AS m, stddev_samp(mean) AS s FROM scores GROUP BY 1),
normal AS (SELECT method, metric, {_case("metric", OBJECTIVES)} AS objective, CASE WHEN {HIGHER} THEN v ELSE 1e0 - v END AS value
  FROM (SELECT method, metric, CASE WHEN s > 0 THEN 1e0 / (1e0 + exp(-(mean - m) / s)) ELSE 0.5e0 END AS v FROM scores JOIN ranges USING (metric)))"""


def _profiles(profiles: dict[str, dict[str, float]] = PROFILES) -> str:
    rows = ", ".join(f"('{p}', '{o}', {w!r}e0)" for p, ws in profiles.items() for o, w in ws.items())
    return f"profiles(profile, objective, weight) AS (VALUES {rows})"


WEIGHTED = "weighted AS (SELECT profile, method, sum(value * weight) AS score FROM normal JOIN profiles USING (objective) GROUP BY 1, 2)"
AVERAGE_RANK = "rank() OVER (PARTITION BY {by} ORDER BY score DESC) + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2e0"
RANKED = f"ranked AS (SELECT profile, method, score, CAST(floor({AVERAGE_RANK.format(by='profile')}) AS INT) AS rank FROM weighted)"
BASE5 = (RESULTS, EFFICIENT, LONG5, SCORES)
MADA = (*BASE5, NORMAL, _profiles(), WEIGHTED, RANKED)
MEANS = "means AS (SELECT method, avg(fidelity_auc) AS fidelity_auc, avg(privacy_dcr) AS privacy_dcr, avg(utility_tstr) AS utility_tstr, avg(fairness_gap) AS fairness_gap FROM results GROUP BY 1)"


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def _values(how: str) -> str:
    minutes = _case("method", RUNTIME_MINUTES, "1e0")
    best, ceiling = REFERENCE_POINTS["efficiency"]["x_best"], REFERENCE_POINTS["efficiency"]["x_ceiling"]
    efficiency = f"CASE WHEN {minutes} <= {best}e0 THEN 1e0 ELSE {_clamp(f'1e0 - ln({minutes} / {best}e0) / ln({ceiling}e0 / {best}e0)')} END"
    refs = {o: (f"{REFERENCE_POINTS[o]['x_worst']}e0", f"{REFERENCE_POINTS[o]['x_best']}e0") for o in ("fidelity", "privacy", "utility", "fairness")}
    if how == "auto":
        refs = {
            "fidelity": ("max(fidelity_auc) OVER ()", "0.5e0"), "privacy": ("min(privacy_dcr) OVER ()", "max(privacy_dcr) OVER ()"),
            "utility": ("min(utility_tstr) OVER ()", "1e0"), "fairness": ("max(fairness_gap) OVER ()", "0e0"),
        }
    cols = []
    for m in CORE_METRICS:
        o = OBJECTIVES[m]
        if how == "minmax":
            v = f"CASE WHEN max({m}) OVER () > min({m}) OVER () THEN ({m} - min({m}) OVER ()) / (max({m}) OVER () - min({m}) OVER ()) ELSE 0.5e0 END"
            cols.append(f"{v if m in ('privacy_dcr', 'utility_tstr') else f'1e0 - {v}'} AS {o}")
        else:
            worst, good = refs[o]
            cols.append(f"{_clamp(f'({m} - {worst}) / ({good} - {worst})')} AS {o}")
    wide = f"wide AS (SELECT method, {', '.join(cols)}, {efficiency} AS efficiency FROM means)"
    return f"{wide},\nvals AS (UNPIVOT wide ON fidelity, privacy, utility, fairness, efficiency INTO NAME objective VALUE value)"


def _grid(base: dict[str, float], attributes: list[str], points: str) -> str:
    """grid(attribute, weight_at, objective, weight); points: a query of w."""
    weights = ", ".join(f"('{o}', {w!r}e0)" for o, w in base.items())
    names = ", ".join(f"('{a}')" for a in attributes)
    return f"""base(objective, weight) AS (VALUES {weights}), points AS ({points}), attributes(attribute) AS (VALUES {names}),
grid AS (SELECT attribute, w AS weight_at, objective, CASE WHEN objective = attribute THEN w ELSE weight / (SELECT sum(weight) FROM base b WHERE b.objective <> attribute) * (1e0 - w) END AS weight
  FROM attributes, points, base)"""


GRID_SCORES = "grid_scores AS (SELECT attribute, weight_at, method, sum(value * grid.weight) AS score FROM {values} JOIN grid USING (objective) GROUP BY 1, 2, 3)"
COLLAPSED = "collapsed AS (SELECT method, CASE WHEN objective IN ('fidelity', 'privacy') THEN 'data_similarity' ELSE objective END AS objective, avg(value) AS value FROM vals GROUP BY 1, 2)"


def _collapsed_profiles() -> dict[str, dict[str, float]]:
    return {p: {"data_similarity": w["fidelity"] + w["privacy"], "utility": w["utility"], "fairness": w["fairness"], "efficiency": w["efficiency"]} for p, w in PROFILES.items()}


def _pareto(x: str, y: str) -> str:
    return _with(RESULTS, MEANS, f"points AS (SELECT method, {x} AS x, {y} AS y FROM means)", select="""SELECT method, round(x, 6) AS x, round(y, 6) AS y,
  NOT EXISTS (SELECT 1 FROM points o WHERE o.x >= p.x AND o.y >= p.y AND (o.x > p.x OR o.y > p.y)) AS optimal FROM points p""")


STATS = "stats AS (SELECT method, " + ", ".join(f"avg({m}) AS m_{m}, stddev_samp({m}) AS s_{m}" for m in CORE_METRICS) + " FROM results GROUP BY 1)"


def _scaled(x: str, lo: str, hi: str, up: bool) -> str:
    v = f"CASE WHEN {hi} > {lo} THEN ({x} - {lo}) / ({hi} - {lo}) ELSE 0.5e0 END"
    return v if up else f"1e0 - {v}"


def _profile_sum(prefix: str = "") -> str:
    """Rows (profile, score) of a table with one column for each objective: a lateral list of profiles."""
    return "CASE profile " + " ".join(f"WHEN '{p}' THEN " + " + ".join(f"{prefix}{o} * {w!r}e0" for o, w in ws.items()) for p, ws in PROFILES.items()) + " END"


PROFILE_NAMES = "(VALUES " + ", ".join(f"('{p}')" for p in PROFILES) + ") pn(profile)"
VALUES_VOI = f"""mv_wide AS (SELECT method, {", ".join(f"{_scaled(f'm_{m}', f'min(m_{m}) OVER ()', f'max(m_{m}) OVER ()', m in ('privacy_dcr', 'utility_tstr'))} AS {OBJECTIVES[m]}" for m in CORE_METRICS)}, {_case("method", EFFICIENCY_TABLE, "0e0")} AS efficiency FROM stats),
mv AS (SELECT profile, method, {_profile_sum()} AS value FROM mv_wide, {PROFILE_NAMES})"""


def _pick(table: dict[str, str]) -> str:
    return f"coalesce(max(CASE WHEN method = {_case('profile', table)} THEN value END), avg(value))"


STRATEGIES = f"strategies AS (SELECT profile, avg(value) AS s1_random, {_pick(HEURISTIC)} AS s2_heuristic, {_pick(HEURISTIC_INFORMED)} AS s2_informed, max(value) AS s4_benchmark FROM mv GROUP BY 1)"
def _rough(n: int) -> str:
    return f"""rough AS (SELECT profile, avg(value) AS s3_rough FROM (SELECT profile, sim, arg_max(value, value + 0.15e0 * {_normal("'s3'", "sim", "method", "42")}) AS value
  FROM mv, range({n}) t(sim) GROUP BY 1, 2) GROUP BY 1)"""


def _oracle(name: str, inflation: float, n: int) -> str:
    draws = {m: f"(m_{m} + {inflation}e0 * s_{m} * " + _normal("'oracle'", "sim", "method", f"'{m}'", "42") + ")" for m in CORE_METRICS}
    columns = ", ".join(f"{_scaled(draws[m], f'lo_{m}', f'hi_{m}', m in ('privacy_dcr', 'utility_tstr'))} AS {OBJECTIVES[m]}" for m in CORE_METRICS)
    ends = ", ".join(f"min(m_{m}) OVER () AS lo_{m}, max(m_{m}) OVER () AS hi_{m}" for m in CORE_METRICS)
    return f"""{name}_draws AS (SELECT sim, method, {columns}, {_case("method", EFFICIENCY_TABLE, "0e0")} AS efficiency FROM (SELECT *, {ends} FROM stats), range({n}) t(sim)),
{name} AS (SELECT profile, avg(top) AS oracle_raw FROM (SELECT profile, sim, max({_profile_sum()}) AS top FROM {name}_draws, {PROFILE_NAMES} GROUP BY 1, 2) GROUP BY 1)"""


def _voi(oracle: str) -> str:
    share = lambda part: f"CASE WHEN s4_benchmark - s1_random > 0.001e0 THEN ({part}) / (s4_benchmark - s1_random) * 100e0 ELSE 50e0 END"
    return f"""SELECT profile AS archetype, s1_random, s2_heuristic, s2_informed, s3_rough, s4_benchmark, greatest(oracle_raw, s4_benchmark) AS oracle,
  s3_rough - s1_random AS value_of_prioritization, s4_benchmark - s3_rough AS value_of_information, s4_benchmark - s1_random AS total_improvement,
  {share('s3_rough - s1_random')} AS pct_from_prioritization, {share('s4_benchmark - s3_rough')} AS pct_from_information
  FROM strategies JOIN rough USING (profile) JOIN {oracle} USING (profile)"""


VOI_BASE = (RESULTS, STATS, VALUES_VOI, STRATEGIES)
FACTORS = (1.0, 1.25, 1.5, 1.75, 2.0)


def _sweep() -> tuple[str, ...]:
    """The rows of every inflation factor, as v."""
    draws = [_oracle(f"o{i}", f, SIMULATIONS) for i, f in enumerate(FACTORS)]
    each = " UNION ALL ".join(f"SELECT {f}e0 AS factor, * FROM ({_voi(f'o{i}')})" for i, f in enumerate(FACTORS))
    return (*VOI_BASE, _rough(SIMULATIONS), *draws, f"v AS ({each})")


VOI_COLUMNS = ("s1_random", "s2_heuristic", "s2_informed", "s3_rough", "s4_benchmark", "oracle", "value_of_prioritization", "value_of_information", "total_improvement", "pct_from_prioritization", "pct_from_information")


def _monte_carlo() -> str:
    draws = ", ".join(f"m_{m} + coalesce(s_{m}, 0e0) * " + _normal("'mc'", "sim", "method", f"'{m}'", "42") + f" AS {m}" for m in CORE_METRICS)
    w = "OVER (PARTITION BY sim)"
    columns = ", ".join(f"{_scaled(m, f'min({m}) {w}', f'max({m}) {w}', m in ('privacy_dcr', 'utility_tstr'))} AS {OBJECTIVES[m]}" for m in CORE_METRICS)
    return _with(
        RESULTS, STATS, f"drawn AS (SELECT sim, method, {_case('method', RUNTIME_MINUTES, '1e0')} AS minutes, {draws} FROM stats, range({SIMULATIONS}) t(sim))",
        f"vals AS (SELECT sim, method, {columns}, {_scaled('minutes', f'min(minutes) {w}', f'max(minutes) {w}', False)} AS efficiency FROM drawn)",
        f"each AS (SELECT sim, profile, method, {_profile_sum()} AS score FROM vals, {PROFILE_NAMES})",
        f"mc AS (SELECT sim, profile, method, {AVERAGE_RANK.format(by='sim, profile')} AS rank, row_number() OVER (PARTITION BY sim, profile ORDER BY score DESC, method) AS best FROM each)",
        select="""SELECT profile, method, round(avg(CASE WHEN best = 1 THEN 1e0 ELSE 0e0 END), 6) AS p_optimal, round(avg(rank), 6) AS mean_rank,
          CAST(floor(quantile_cont(rank, 0.025)) AS INT) AS rank_ci_low, CAST(floor(quantile_cont(rank, 0.975)) AS INT) AS rank_ci_high FROM mc GROUP BY 1, 2""",
    )


BETWEEN = """grand AS (SELECT metric, avg(value) AS g, count(*) AS n FROM {long} GROUP BY 1),
groups AS (SELECT metric, method, count(*) AS c, avg(value) AS m, var_pop(value) AS v FROM {long} GROUP BY 1, 2),
ss AS (SELECT metric, count(*) AS k, any_value(n) AS n, sum(c * (m - g) * (m - g)) AS ssb, sum(c * v) AS ssw FROM groups JOIN grand USING (metric) GROUP BY 1)"""
KRUSKAL = """kr AS (SELECT metric, method, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY metric, value) AS t FROM long),
kw AS (SELECT metric, (12e0 / (n * (n + 1e0)) * q - 3e0 * (n + 1e0)) / (1e0 - ties / (n * n * n - n)) AS h FROM
  (SELECT metric, CAST(count(*) AS DOUBLE) AS n, sum(t * t - 1e0) AS ties FROM kr GROUP BY 1) JOIN
  (SELECT metric, sum(rs * rs / c) AS q FROM (SELECT metric, method, sum(r) AS rs, count(*) AS c FROM kr GROUP BY 1, 2) GROUP BY 1) USING (metric))"""


def _effect(x: str, steps: tuple[float, float, float]) -> str:
    return f"CASE WHEN {x} < {steps[0]}e0 THEN 'negligible' WHEN {x} < {steps[1]}e0 THEN 'small' WHEN {x} < {steps[2]}e0 THEN 'medium' ELSE 'large' END"


def _pairwise(first: str) -> str:
    """first: condition that a.method comes before b.method."""
    return f"""each AS (SELECT metric, method, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM long GROUP BY 1, 2),
pairs AS (SELECT a.metric, a.method AS method_1, b.method AS method_2, a.n AS n_1, b.n AS n_2, a.mean AS mean_1, b.mean AS mean_2,
  ((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2) AS pooled FROM each a JOIN each b ON a.metric = b.metric AND {first}),
pr AS (SELECT p.metric, method_1, method_2, method, rank() OVER (PARTITION BY p.metric, method_1, method_2 ORDER BY value) + (count(*) OVER (PARTITION BY p.metric, method_1, method_2, value) - 1) / 2e0 AS r
  FROM pairs p JOIN long l ON l.metric = p.metric AND l.method IN (method_1, method_2)),
us AS (SELECT metric, method_1, method_2, sum(CASE WHEN method = method_1 THEN r ELSE 0e0 END) - count(*) FILTER (method = method_1) * (count(*) FILTER (method = method_1) + 1) / 2e0 AS u FROM pr GROUP BY 1, 2, 3)"""


def _p_f(f: str, d1: str, d2: str) -> str:
    """Upper tail of the F distribution for even degrees of freedom, a finite binomial sum."""
    x, n = f"({d2} / ({d2} + {d1} * ({f})))", f"(({d1} + {d2}) // 2 - 1)"
    return f"list_sum(list_transform(range({d2} // 2, {n} + 1), lambda j: factorial(CAST({n} AS INT)) / CAST(factorial(CAST(j AS INT)) * factorial(CAST({n} - j AS INT)) AS DOUBLE) * pow({x}, j) * pow(1e0 - {x}, {n} - j)))"


def _p_chi2(x: str, df: str) -> str:
    """Upper tail of the chi-squared distribution for an even number of degrees of freedom."""
    return f"exp(-({x}) / 2) * list_sum(list_transform(range(0, {df} // 2), lambda j: pow(({x}) / 2, j) / CAST(factorial(CAST(j AS INT)) AS DOUBLE)))"


def _p_t(t: str, df: str) -> str:
    """Two-sided tail of Student's t for an even number of degrees of freedom."""
    c = f"({df} / ({df} + ({t}) * ({t})))"
    return f"1e0 - abs({t}) / sqrt({df} + ({t}) * ({t})) * list_sum(list_transform(range(0, {df} // 2), lambda j: CAST(factorial(CAST(2 * j AS INT)) AS DOUBLE) / CAST(factorial(CAST(j AS INT)) * factorial(CAST(j AS INT)) AS DOUBLE) / pow(4, j) * pow({c}, j)))"


#: Tails of U for two samples of five without ties, from all choices of five ranks of ten.
_U_TAILS = """chosen AS (WITH RECURSIVE c(i, k, s) AS (SELECT 0, 0, 0 UNION ALL SELECT i + 1, k + b, s + b * (i + 1) FROM c, (VALUES (0), (1)) t(b) WHERE i < 10) SELECT s - 15 AS u FROM c WHERE i = 10 AND k = 5),
tails AS (SELECT u.u, least(1e0, 2e0 * (SELECT count(*) FROM chosen WHERE chosen.u >= u.u) / 252) AS p FROM (SELECT range AS u FROM range(26)) u)"""


def _tested(first: str, methods: str) -> list[str]:
    """CTEs up to tested: metric, method_1, method_2, t_p, mw_p and the corrected level; methods: their number."""
    t = "((mean_1 - mean_2) / sqrt(pooled * (1e0 / n_1 + 1e0 / n_2)))"
    return [RESULTS, LONG, _pairwise(first), _U_TAILS, f"""tested AS (SELECT metric, method_1, method_2, {_p_t(t, '(n_1 + n_2 - 2)')} AS t_p, p AS mw_p, 0.05e0 / ({methods} * ({methods} - 1) / 2) AS level
  FROM pairs JOIN us USING (metric, method_1, method_2) JOIN tails ON tails.u = CAST(ceil(greatest(us.u, n_1 * n_2 - us.u)) AS BIGINT) AND n_1 = 5 AND n_2 = 5)"""]


TIER = {"ctgan": 0, "dpbn": 1, "great": 2}


def _correlations(points: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{a}' AS metric_1, '{b}' AS metric_2, {a} AS x, {b} AS y FROM {points} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in combinations(CORE_METRICS, 2))
    rank = lambda c: f"rank() OVER (PARTITION BY metric_1, metric_2 ORDER BY {c}) + (count(*) OVER (PARTITION BY metric_1, metric_2, {c}) - 1) / 2e0"
    return f"""xy AS ({parts}), rxy AS (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry FROM xy),
corrs AS (SELECT metric_1, metric_2, count(*) AS n, round(corr(x, y), 6) + 0e0 AS pearson, round(corr(rx, ry), 6) + 0e0 AS spearman FROM rxy GROUP BY 1, 2)"""


def _expected(side: int) -> str:
    return "CASE " + " ".join(f"WHEN metric_1 = '{a}' AND metric_2 = '{b}' THEN {r[side]}e0" for (a, b), r in EXPECTED_CORRELATIONS.items()) + " END"


RECORDS = """records AS (SELECT p_partkey AS row_id, p_size + 2 AS AGEP, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice * 40e0 END AS PINCP, CAST(p_partkey % 2 + 1 AS INT) AS SEX,
  CAST(p_partkey % 5 + 1 AS INT) AS MAR, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 6 AS DOUBLE) END AS ESR, CAST(p_partkey % 90 + 1 AS INT) AS PWGTP,
  CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 9 + 1 END AS RAC1P, CASE WHEN p_partkey % 17 <> 0 THEN CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END END AS HISP,
  CASE WHEN p_partkey % 19 <> 0 THEN p_partkey % 26 END AS SCHL, CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 600 END AS POBP FROM part),
recoded AS (SELECT row_id, AGEP, PINCP, SEX, CASE WHEN HISP > 1 THEN 4 WHEN RAC1P = 1 THEN 1 WHEN RAC1P = 2 THEN 2 WHEN RAC1P = 6 THEN 3 ELSE 5 END AS RACETH,
  CASE WHEN SCHL IS NULL THEN NULL WHEN SCHL <= 15 THEN 1 WHEN SCHL <= 17 THEN 2 WHEN SCHL <= 20 THEN 3 WHEN SCHL = 21 THEN 4 WHEN SCHL <= 24 THEN 5 ELSE 1 END AS SCHL_RECODED, MAR, ESR,
  CASE WHEN POBP = 6 THEN 1 WHEN POBP BETWEEN 1 AND 56 THEN 2 WHEN POBP = 303 THEN 3 WHEN POBP BETWEEN 200 AND 299 THEN 5 WHEN POBP BETWEEN 300 AND 399 THEN 6 WHEN POBP BETWEEN 100 AND 199 THEN 4 ELSE 7 END AS POBP_RECODED, PWGTP FROM records)"""
ADULTS = "adults AS (SELECT * FROM recoded WHERE AGEP >= 18 AND PINCP IS NOT NULL)"
MICRO = """micro AS (SELECT o_orderkey AS row_id, o_totalprice AS price, c_acctbal AS balance, coalesce(c_mktsegment, 'NONE') AS segment, o_orderstatus AS status,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 50 END AS age FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
SHUFFLED = "row_number() OVER (ORDER BY md5(concat_ws(':', row_id, 'shuffle', 42)), row_id)"


def _vec(n: int) -> str:
    return f"train AS (SELECT vec_id AS t, embedding[1:{n}]::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0), synth AS (SELECT vec_id AS row_id, embedding[1:{n}]::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 1)"


_DISTANCES = {
    "euclidean": "list_distance(s.e, t.e)",
    "cityblock": "list_sum(list_transform(list_zip(s.e, t.e), lambda p: abs(p[1] - p[2])))",
    "cosine": "1e0 - list_cosine_similarity(s.e, t.e)",
}


def _near(metric: str, n: int) -> tuple[str, str]:
    return _vec(n), f"near AS (SELECT s.row_id, min({_DISTANCES[metric]}) AS dcr, arg_min(t.t, ({_DISTANCES[metric]}, t.t)) AS closest FROM synth s, train t GROUP BY 1)"


DCR = """dcr AS (SELECT quantile_cont(dcr, 0.05) AS dcr_percentile, avg(dcr) AS dcr_mean, quantile_cont(dcr, 0.5) AS dcr_median, min(dcr) AS dcr_min, stddev_pop(dcr) AS dcr_std, count(*) AS n FROM near)"""
CLASSIFIED = """classified AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, l_discount * 10 AS score, l_linestatus AS grp, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS pred_real,
  CASE WHEN l_tax > 0.035e0 THEN 1 ELSE 0 END AS pred_synth, l_linestatus || '-' || CAST(l_suppkey % 4 AS VARCHAR) AS subgroup FROM lineitem)"""


def _auc(by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    name = "grp AS \"group\", " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return _with(CLASSIFIED, f"r AS (SELECT *, rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}score) - 1) / 2e0 AS rk FROM classified)", select=f"""SELECT {name}round((sum(CASE WHEN label = 1 THEN rk ELSE 0e0 END)
  - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1e0) / 2e0) / (count(*) FILTER (label = 1) * CAST(count(*) FILTER (label = 0) AS DOUBLE)), 6) AS auc FROM r {group}""")


def _f1(pred: str) -> str:
    return f"coalesce(2e0 * count(*) FILTER ({pred} = 1 AND label = 1) / nullif(count(*) FILTER ({pred} = 1) + count(*) FILTER (label = 1), 0), 0e0)"


def _subgroups(minimum: int) -> str:
    return f"""sg AS (SELECT subgroup, count(*) AS n, {_f1('pred_real')} AS f1_real, {_f1('pred_synth')} AS f1_synth FROM classified GROUP BY 1),
sr AS (SELECT *, CASE WHEN f1_real > 0 THEN f1_synth / f1_real ELSE 0e0 END AS f1_ratio, n >= {minimum} AS kept FROM sg)"""


def _frequency(column: str) -> str:
    return f"""SELECT {column} AS value, round(n / total, 6) AS p, round((run - n) / total, 6) AS lo, round(run / total, 6) AS hi, '{column}' AS column_name FROM
  (SELECT {column}, CAST(n AS DOUBLE) AS n, sum(n) OVER (ORDER BY {column} NULLS FIRST) AS run, sum(n) OVER () AS total FROM (SELECT {column}, count(*) AS n FROM micro GROUP BY 1))"""


def _drawn(column: str) -> str:
    return f"""cdf_{column} AS (SELECT {column} AS v, (sum(n) OVER (ORDER BY {column} NULLS FIRST) - n) / CAST(sum(n) OVER () AS DOUBLE) AS lo, sum(n) OVER (ORDER BY {column} NULLS FIRST) / CAST(sum(n) OVER () AS DOUBLE) AS hi
  FROM (SELECT {column}, count(*) AS n FROM micro GROUP BY 1)),
drawn_{column} AS (SELECT id, v AS {column} FROM (SELECT range AS id, {_uniform("range", f"'{column}'", "42")} AS u FROM range(1000)) JOIN cdf_{column} ON u >= lo AND u < hi)"""


def _heat() -> str:
    ones = " UNION ALL ".join(f"SELECT '{m}', '{m}', 1e0" for m in CORE_METRICS)
    return f"SELECT metric_1, metric_2, spearman AS rho FROM corrs UNION ALL SELECT metric_2, metric_1, spearman FROM corrs UNION ALL {ones}"


def oracle_sql() -> dict[str, str]:
    means = ", ".join(CORE_METRICS)
    unpivot_flawed = _correlations("flawed")
    bars = (RESULTS, LONG, "ms AS (SELECT method, metric, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n FROM long GROUP BY 1, 2)")
    reference, auto, minmax = (_values(h) for h in ("reference", "auto", "minmax"))
    level = _with(
        RESULTS, LONG, "med AS (SELECT metric, method, median(value) AS m FROM long GROUP BY 1, 2)", "dev AS (SELECT metric, method, abs(value - m) AS value FROM long JOIN med USING (metric, method))",
        BETWEEN.format(long="dev"), select="SELECT metric, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS statistic FROM ss",
    )
    pair_stats = "round((mean_1 - mean_2) / sqrt(pooled * (1e0 / n_1 + 1e0 / n_2)), 6) AS t, round(u, 6) AS u, round((mean_1 - mean_2) / sqrt(pooled), 6) AS cohens_d"
    tier_order = f"{_case('a.method', {k: str(v) for k, v in TIER.items()})} < {_case('b.method', {k: str(v) for k, v in TIER.items()})}"
    efficiency = lambda x: _with(RESULTS, select=f"SELECT method, round(avg({x}), 6) AS mean FROM results GROUP BY 1")
    dcr_near = _near("euclidean", 64)
    per_record = lambda metric, n: _with(*_near(metric, n), select="SELECT row_id, round(dcr, 6) AS dcr, closest FROM near")
    some = "picked AS (SELECT t, e FROM train ORDER BY md5(concat_ws(':', t, 'pairs', 42)), t LIMIT 1000)"
    pair_distance = "pd AS (SELECT list_distance(a.e, b.e) AS d FROM picked a JOIN picked b ON a.t < b.t)"
    # The measure scales both sides by the train side's moments first.
    moments = ", ".join(f"avg(e[{i}]) AS m{i}, CASE WHEN stddev_pop(e[{i}]) = 0 THEN 1e0 ELSE stddev_pop(e[{i}]) END AS s{i}" for i in range(1, 65))
    flat = "[" + ", ".join(f"(e[{i}] - m{i}) / s{i}" for i in range(1, 65)) + "]"
    scaled = f"mom AS (SELECT {moments} FROM raw_train), train AS (SELECT t, {flat} AS e FROM raw_train, mom), synth AS (SELECT row_id, {flat} AS e FROM raw_synth, mom)"
    return {
        "method_means": _with(RESULTS, MEANS, select=f"SELECT method, {_r(*CORE_METRICS)} FROM means"),
        "method_means_std": _with(*bars, select=f"SELECT method, metric, {_r('mean', 'std')}, n FROM ms"),
        "summary_rounded": _with(RESULTS, select="SELECT method, " + ", ".join(f"round(avg({m}), 4) AS {m}_mean, round(stddev_samp({m}), 4) AS {m}_std" for m in CORE_METRICS) + " FROM results GROUP BY 1"),
        "descriptive_ci": _with(RESULTS, LONG, select="""SELECT method, metric, n, round(mean, 6) AS mean, round(std, 6) AS std, round(mean - 2.7764451051977987e0 * std / sqrt(n), 6) AS ci_lower,
          round(mean + 2.7764451051977987e0 * std / sqrt(n), 6) AS ci_upper, round(lo, 6) AS min, round(hi, 6) AS max
          FROM (SELECT method, metric, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1, 2)"""),
        "quality_issues": _with(RESULTS, FLAWED, select="""SELECT 'constant_values' AS type, method, 'utility_tstr' AS column_name, count(*) AS count FROM flawed GROUP BY method HAVING count(*) > 1 AND min(utility_tstr) = max(utility_tstr)
          UNION ALL SELECT 'missing_values', NULL, 'fairness_gap', count(*) FROM flawed WHERE fairness_gap IS NULL HAVING count(*) > 0"""),
        "means_with_missing": _with(RESULTS, FLAWED, select="SELECT method, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in CORE_METRICS) + " FROM flawed GROUP BY 1"),
        "efficiency_default": efficiency(_case("method", RUNTIME_MINUTES)),
        "efficiency_minutes": efficiency("replicate * 2e0"),
        "efficiency_seconds": efficiency("replicate * 90e0 / 60e0"),
        "efficiency_given": efficiency("replicate + 0.5e0"),
        "normalize_minmax": _with(*BASE5, NORMAL, select="SELECT method, metric, objective, round(value, 6) AS value FROM normal"),
        "normalize_zscore": _with(*BASE5, ZNORMAL, select="SELECT method, metric, objective, round(value, 6) AS value FROM normal"),
        "weighted_scores": _with(*MADA, select="SELECT profile, method, round(score, 6) AS score FROM weighted"),
        "rank_balanced": _with(*MADA, select="SELECT profile, method, round(score, 6) AS score, rank FROM ranked WHERE profile = 'balanced'"),
        "rank_all_profiles": _with(*MADA, select="SELECT profile, method, round(score, 6) AS score, rank FROM ranked"),
        "rank_zscore": _with(*BASE5, ZNORMAL, _profiles(), WEIGHTED, RANKED, select="SELECT profile, method, round(score, 6) AS score, rank FROM ranked"),
        "top2_advantage": _with(*MADA, "o AS (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY score DESC, method) AS i FROM ranked)", select="""SELECT a.profile, a.method AS leader, b.method AS second, round(a.score - b.score, 6) AS advantage
          FROM o a JOIN o b ON a.profile = b.profile AND a.i = 1 AND b.i = 2"""),
        "sensitivity_sweep": _with(*BASE5, NORMAL, _grid(PROFILES["balanced"], ["privacy"], "SELECT 0.8e0 * i / 19 AS w FROM range(20) t(i)"), GRID_SCORES.format(values="normal"), select=f"SELECT attribute, {_r('weight_at')}, method, {_r('score')} FROM grid_scores"),
        "value_functions_reference": _with(RESULTS, MEANS, reference, select="SELECT method, objective, round(value, 6) AS value FROM vals"),
        "value_functions_auto": _with(RESULTS, MEANS, auto, select="SELECT method, objective, round(value, 6) AS value FROM vals"),
        "value_functions_minmax": _with(RESULTS, MEANS, minmax, select="SELECT method, objective, round(value, 6) AS value FROM vals"),
        "value_profile_scores": _with(RESULTS, MEANS, minmax, _profiles(), WEIGHTED.replace("FROM normal", "FROM vals"), RANKED, select="SELECT profile, method, round(score, 6) AS score, rank FROM ranked"),
        "value_form_sensitivity": _with(*BASE5, NORMAL, _profiles({"balanced": PROFILES["balanced"]}), "forms(form) AS (VALUES ('linear'), ('concave'), ('convex'), ('logistic'), ('step'))",
          """fs AS (SELECT form, method, sum(weight * CASE form WHEN 'concave' THEN sqrt(value) WHEN 'convex' THEN value * value WHEN 'logistic' THEN 1e0 / (1e0 + exp(-10e0 * (value - 0.5e0)))
          WHEN 'step' THEN CASE WHEN value > 0.5e0 THEN 1e0 ELSE 0e0 END ELSE value END) AS score FROM normal JOIN profiles USING (objective), forms GROUP BY 1, 2)""",
          select=f"SELECT form, method, round(score, 6) AS score, CAST(floor({AVERAGE_RANK.format(by='form')}) AS INT) AS rank FROM fs"),
        "tornado": _with(RESULTS, MEANS, minmax, _grid(PROFILES["balanced"], list(PROFILES["balanced"]), "SELECT unnest([0.05e0, 0.5e0]) AS w"), GRID_SCORES.format(values="vals"),
          "tops AS (SELECT attribute, weight_at, max(score) AS top FROM grid_scores GROUP BY 1, 2)", select="SELECT attribute AS objective, round(min(top), 6) AS lo, round(max(top), 6) AS hi, round(max(top) - min(top), 6) AS range FROM tops GROUP BY 1"),
        "collapsed_profiles": _with(RESULTS, MEANS, minmax, COLLAPSED, _profiles(_collapsed_profiles()), WEIGHTED.replace("FROM normal", "FROM collapsed"), RANKED, select="SELECT profile, method, round(score, 6) AS score, rank FROM ranked"),
        "breakeven_collapsed": _with(RESULTS, MEANS, minmax, COLLAPSED, _grid(_collapsed_profiles()["balanced"], ["data_similarity"], "SELECT i / 100e0 AS w FROM range(5, 85) t(i)"), GRID_SCORES.format(values="collapsed"),
          "o AS (SELECT *, row_number() OVER (PARTITION BY weight_at ORDER BY score DESC, method) AS i FROM grid_scores)", select="SELECT round(min(weight_at), 6) AS breakeven FROM o WHERE i = 1 AND method = 'dpbn'"),
        "pareto_privacy_fidelity": _pareto("privacy_dcr", "1e0 - fidelity_auc"),
        "pareto_fidelity_utility": _pareto("1e0 - fidelity_auc", "utility_tstr"),
        "pareto_fidelity_utility_legacy": _pareto("fidelity_auc", "utility_tstr"),
        "mc_optimality": _monte_carlo(),
        "voi_method_values": _with(RESULTS, STATS, VALUES_VOI, select="SELECT profile, method, round(value, 6) AS value FROM mv"),
        "voi_strategies": _with(RESULTS, STATS, VALUES_VOI, STRATEGIES, select=f"SELECT profile, {_r('s1_random', 's2_heuristic', 's2_informed', 's4_benchmark')} FROM strategies"),
        "voi_s3_mc": _with(*VOI_BASE, _rough(VOI_SIMULATIONS), select="SELECT profile, round(s3_rough, 6) AS s3_rough FROM rough"),
        "voi_oracle_mc": _with(RESULTS, STATS, _oracle("orc", 1.5, VOI_SIMULATIONS), select="SELECT profile, round(oracle_raw, 6) AS oracle_raw FROM orc"),
        "voi_decomposition": _with(*VOI_BASE, _rough(VOI_SIMULATIONS), _oracle("orc", 1.5, VOI_SIMULATIONS), f"voi AS ({_voi('orc')})", select=f"SELECT archetype, {_r(*VOI_COLUMNS)} FROM voi"),
        "inflation_verdict": _with(*_sweep(), """sweep AS (SELECT factor, avg(pct_from_prioritization) AS pct FROM v GROUP BY 1)""",
          select="""SELECT min(factor) AS least_factor, max(factor) AS greatest_factor, round(min(pct), 6) AS least_pct, round(max(pct), 6) AS greatest_pct, CASE WHEN min(pct) > 50 THEN 'robust' ELSE 'sensitive' END AS verdict FROM sweep"""),
        "inflation_sensitivity": _with(*_sweep(),
          select="""SELECT factor, round(avg(pct_from_prioritization), 6) AS mean_pct_prioritization, round(avg(pct_from_information), 6) AS mean_pct_information, round(avg(oracle), 6) AS mean_oracle,
          round(avg(s4_benchmark), 6) AS mean_s4, round(avg(oracle - s4_benchmark), 6) AS mean_evpi_gap FROM v GROUP BY 1"""),
        "anova_kruskal": _with(RESULTS, LONG, BETWEEN.format(long="long"), KRUSKAL, select=f"""SELECT metric, round((ssb / (k - 1)) / (ssw / (n - k)), 6) AS anova_f, round(h, 6) AS kruskal_h, round(ssb / (ssb + ssw), 6) AS eta_squared,
          {_effect('ssb / (ssb + ssw)', (0.01, 0.06, 0.14))} AS effect, k AS n_groups FROM ss JOIN kw USING (metric)"""),
        "levene_w": level,
        "omnibus_p_values": _with(RESULTS, LONG, BETWEEN.format(long="long"), KRUSKAL, select=f"""SELECT metric, round({_p_f('(ssb / (k - 1)) / (ssw / (n - k))', '(k - 1)', '(n - k)')}, 6) + 0e0 AS anova_p, round({_p_chi2('h', '(k - 1)')}, 6) + 0e0 AS kruskal_p FROM ss JOIN kw USING (metric)"""),
        "pairwise_p_values": _with(*_tested("a.method < b.method", "5"), select="SELECT metric, method_1, method_2, round(t_p, 6) + 0e0 AS t_p, t_p < level AS t_significant, round(mw_p, 6) + 0e0 AS mw_p, mw_p < level AS mw_significant, round(level, 6) AS adjusted_alpha FROM tested"),
        "middle_tier_counts": _with(*_tested(tier_order, "3"), select="""SELECT metric, count(*) FILTER (t_p < level) AS n_significant_t, count(*) FILTER (mw_p < level) AS n_significant_mw,
          count(*) FILTER (t_p < level OR mw_p < level) > 0 AS any_significant FROM tested GROUP BY 1"""),
        "pairwise_t_u_d": _with(RESULTS, LONG, _pairwise("a.method < b.method"), select=f"""SELECT metric, method_1, method_2, n_1, n_2, round(mean_1 - mean_2, 6) AS mean_diff, {pair_stats},
          {_effect('abs((mean_1 - mean_2) / sqrt(pooled))', (0.2, 0.5, 0.8))} AS effect FROM pairs JOIN us USING (metric, method_1, method_2)"""),
        "middle_tier_pairs": _with(RESULTS, LONG, _pairwise(tier_order), select=f"SELECT metric, method_1, method_2, {_r('mean_1', 'mean_2')}, {pair_stats}, round(0.05e0 / 3, 6) AS adjusted_alpha FROM pairs JOIN us USING (metric, method_1, method_2)"),
        "correlation_means": _with(RESULTS, MEANS, _correlations("means"), f"ex AS (SELECT *, {_expected(0)} AS expected_low, {_expected(1)} AS expected_high FROM corrs)",
          select="SELECT *, spearman BETWEEN expected_low AND expected_high AS within_expected, abs(spearman) > 0.85e0 AS high_correlation FROM ex"),
        "correlation_replicates": _with(RESULTS, _correlations("results"), select="SELECT * FROM corrs"),
        "correlation_with_missing": _with(RESULTS, FLAWED, unpivot_flawed, select="SELECT * FROM corrs"),
        "recode_case_ladder": _with(RECORDS, select="SELECT * FROM recoded"),
        "prepared_records": _with(RECORDS, ADULTS, select="SELECT * FROM adults"),
        "preprocess_sample_split": _with(RECORDS, ADULTS, f"s AS (SELECT row_id FROM adults QUALIFY {SHUFFLED} <= 900)", f"o AS (SELECT row_id, {SHUFFLED} AS i, count(*) OVER () AS n FROM s)",
          select="SELECT row_id, CASE WHEN i <= floor(n * 0.7e0) THEN 'train' ELSE 'test' END AS part FROM o"),
        "distinct_counts": _with(RECORDS, select="SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in ("row_id", "AGEP", "PINCP", "SEX", "RACETH", "SCHL_RECODED", "MAR", "ESR", "POBP_RECODED", "PWGTP")) + " FROM recoded"),
        "binarize_target": _with(MICRO, select="SELECT row_id, CASE WHEN age > 25 THEN 1 ELSE 0 END AS target FROM micro"),
        "sample_exact": _with(MICRO, select=f"SELECT row_id, segment FROM micro QUALIFY {SHUFFLED} <= 500"),
        "train_test_split": _with(MICRO, f"o AS (SELECT row_id, segment, {SHUFFLED} AS i, count(*) OVER () AS n FROM micro)", select="SELECT row_id, segment, CASE WHEN i <= floor(n * 0.7e0) THEN 'train' ELSE 'test' END AS part FROM o"),
        "stratified_kfold": _with(MICRO, select="SELECT row_id, status, CAST((row_number() OVER (PARTITION BY status ORDER BY md5(concat_ws(':', row_id, 'fold', 42)), row_id) - 1) % 3 AS INT) AS fold FROM micro"),
        "ordered_kfold": _with(MICRO, select="SELECT row_id, status, CAST(ntile(5) OVER (PARTITION BY status ORDER BY row_id) - 1 AS INT) AS fold FROM micro"),
        "position_halves": _with(MICRO, select="SELECT row_id, CASE WHEN row_number() OVER (ORDER BY row_id) <= count(*) OVER () // 2 THEN 1 ELSE 2 END AS half FROM micro"),
        "one_hot_drop_first": _with(MICRO, select="SELECT row_id, " + ", ".join(f"CASE WHEN segment = '{v}' THEN 1e0 ELSE 0e0 END AS segment_{v}" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + ", " + ", ".join(f"CASE WHEN status = '{v}' THEN 1e0 ELSE 0e0 END AS status_{v}" for v in ("O", "P")) + " FROM micro"),
        "median_fill": _with(MICRO, select="SELECT row_id, round(coalesce(CAST(age AS DOUBLE), (SELECT quantile_cont(age, 0.5) FROM micro)), 6) AS age, round(price, 6) AS price FROM micro"),
        "zscore_scale": _with(MICRO, select="SELECT row_id, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS price, round((age - avg(age) OVER ()) / stddev_pop(age) OVER (), 6) AS age FROM micro"),
        "uniform_draws": f"SELECT o_orderkey, round({_uniform('o_orderkey', chr(39) + 'salt' + chr(39), '42')}, 6) AS u FROM orders",
        "marginals_fit": _with(MICRO, select=_frequency("segment") + " UNION ALL " + _frequency("status")),
        "marginals_sample": _with(MICRO, _drawn("segment"), _drawn("status"), select="SELECT id AS row_id, segment, status FROM drawn_segment JOIN drawn_status USING (id)"),
        "mutual_information": _with(MICRO, "j AS (SELECT segment, status, count(*) AS n FROM micro GROUP BY 1, 2)", select="""SELECT round(sum(n / CAST(t AS DOUBLE) * ln(n * CAST(t AS DOUBLE) / (na * nb))), 6) AS mi FROM
          (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY segment) AS na, sum(n) OVER (PARTITION BY status) AS nb FROM j)"""),
        "dcr_nn_per_record": per_record("euclidean", 64),
        "dcr_pivoted": per_record("euclidean", 64),
        "dcr_cityblock": per_record("cityblock", 64),
        "dcr_cosine": per_record("cosine", 64),
        "dcr_summary": _with(*dcr_near, DCR, select=f"""SELECT {_r('dcr_percentile', 'dcr_mean', 'dcr_median', 'dcr_min', 'dcr_std')}, n, (SELECT count(*) FROM near WHERE near.dcr < dcr_min + dcr_std) AS n_close_matches,
          round((SELECT count(*) FROM near WHERE near.dcr < dcr_min + dcr_std) * 100e0 / n, 6) AS pct_close_matches FROM dcr"""),
        "typical_distance": _with(_vec(64), some, pair_distance, select="SELECT count(*) AS pairs, round(quantile_cont(d, 0.5), 6) AS typical_distance FROM pd"),
        "dcr_privacy": _with(_vec(64).replace("train AS", "raw_train AS").replace("synth AS", "raw_synth AS"), scaled, dcr_near[1], DCR, some, pair_distance, "ty AS (SELECT quantile_cont(d, 0.5) AS typical_distance FROM pd)",
          select=f"SELECT {_r('dcr_percentile', 'dcr_mean', 'typical_distance')}, round(least(1e0, dcr_percentile / (2e0 * typical_distance)), 6) AS privacy_score FROM dcr, ty"),
        "dcr_compared": _with(_vec(64).replace("train AS", "raw_train AS").replace("synth AS", "raw_synth AS"), scaled.replace("synth AS (SELECT row_id", "both_sides AS (SELECT 'odd' AS method, row_id").replace("FROM raw_synth, mom)", "FROM raw_synth, mom UNION ALL SELECT 'copies', t, e FROM train)"),
          f"near AS (SELECT s.method, s.row_id, min({_DISTANCES['euclidean']}) AS dcr FROM both_sides s, train t GROUP BY 1, 2)", some, pair_distance, "ty AS (SELECT quantile_cont(d, 0.5) AS typical_distance FROM pd)",
          "dcr AS (SELECT method, quantile_cont(dcr, 0.05) AS dcr_percentile, avg(dcr) AS dcr_mean, min(dcr) AS dcr_min, count(*) AS n_synthetic FROM near GROUP BY 1)",
          select=f"SELECT method, {_r('dcr_percentile', 'dcr_mean', 'dcr_min')}, n_synthetic, round(typical_distance, 6) AS typical_distance, round(least(1e0, dcr_percentile / (2e0 * typical_distance)), 6) AS privacy_score FROM dcr, ty"),
        "dcr_per_record_measure": per_record("euclidean", 64).replace("closest FROM near", "closest AS closest_train_id FROM near"),
        "union_by_name": _with(MICRO, select="SELECT row_id, segment, age, 0 AS label FROM micro UNION ALL SELECT row_id, segment, NULL, 1 FROM micro"),
        "running_means": _with(RESULTS, select="SELECT method, count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in CORE_METRICS) + " FROM results GROUP BY 1"),
        "auc_exact_ranks": _auc(""),
        "auc_by_group": _auc("grp"),
        "f1_by_subgroup": _with(CLASSIFIED, _subgroups(7500), select=f"SELECT subgroup, n, {_r('f1_real', 'f1_synth', 'f1_ratio')}, kept FROM sr"),
        "fairness_gap_from_predictions": _with(CLASSIFIED, _subgroups(100), f"ov AS (SELECT {_f1('pred_synth')} / {_f1('pred_real')} AS overall FROM classified)", "g AS (SELECT subgroup, abs(f1_ratio - overall) AS gap FROM sr, ov WHERE kept)",
          select="SELECT round(max(gap), 6) AS max_gap, round(avg(gap), 6) AS mean_gap, arg_max(subgroup, (gap, subgroup)) AS worst_subgroup, round(greatest(0e0, 1e0 - max(gap) / 0.5e0), 6) AS fairness_score FROM g"),
        "mi_rates_from_scores": _with(CLASSIFIED, "m AS (SELECT grp, avg(CASE WHEN score > 0.5e0 THEN 1e0 ELSE 0e0 END) AS rate FROM classified GROUP BY 1)", select="SELECT grp AS \"group\", round(rate, 6) AS rate, round(1e0 - 2e0 * abs(rate - 0.5e0), 6) AS privacy_score FROM m"),
        "pending_runs": _with(RESULTS, select="SELECT method || '_rep' || CAST(replicate AS VARCHAR) AS run_id, replicate FROM results WHERE replicate > 3"),
        "plot_method_bars": _with(*bars, select=f"SELECT method, metric, {_r('mean', 'std')}, mean = CASE WHEN {HIGHER} THEN max(mean) OVER (PARTITION BY metric) ELSE min(mean) OVER (PARTITION BY metric) END AS is_best FROM ms"),
        "plot_tradeoffs": _with(*bars, "w(x_metric, y_metric) AS (VALUES ('fidelity_auc', 'utility_tstr'), ('privacy_dcr', 'utility_tstr'), ('privacy_dcr', 'fidelity_auc'))", select="""SELECT x_metric, y_metric, a.method, round(a.mean, 6) AS x, round(a.std, 6) AS x_std,
          round(b.mean, 6) AS y, round(b.std, 6) AS y_std FROM w JOIN ms a ON a.metric = x_metric JOIN ms b ON b.metric = y_metric AND a.method = b.method"""),
        "plot_boxes": _with(RESULTS, LONG, select="SELECT method, metric, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(max(value), 6) AS max FROM long GROUP BY 1, 2"),
        "plot_box_points": _with(RESULTS, f"lr AS (UNPIVOT (SELECT method, replicate, {means} FROM results) ON {means} INTO NAME metric VALUE value)",
          select="SELECT method, replicate, metric, round(value, 6) AS value, round((" + _uniform("'jitter'", "method", "replicate", "metric", "42") + " - 0.5e0) * 0.2e0, 6) AS jitter FROM lr"),
        "plot_heatmap": _with(RESULTS, MEANS, _correlations("means"), select=_heat()),
        "plot_radar": _with(*BASE5, NORMAL, select="SELECT method, metric, round(value, 6) AS value FROM normal WHERE metric <> 'efficiency_time'"),
        "plot_radar_legacy": _with(*BASE5, NORMAL, select="SELECT method, metric, round(CASE WHEN metric = 'fidelity_auc' THEN 1e0 - value ELSE value END, 6) AS value FROM normal WHERE metric <> 'efficiency_time'"),
        "plot_contributions": _with(*BASE5, NORMAL, _profiles({"balanced": PROFILES["balanced"]}), select="SELECT method, objective, round(value * weight, 6) AS contribution FROM normal JOIN profiles USING (objective)"),
        "plot_profile_sensitivity": _with(*BASE5, NORMAL, _grid(PROFILES["balanced"], list(PROFILES["balanced"]), "SELECT 0.8e0 * i / 19 AS w FROM range(20) t(i)"), GRID_SCORES.format(values="normal"), select=f"SELECT attribute, {_r('weight_at')}, method, {_r('score')} FROM grid_scores"),
        "plot_profile_comparison": _with(RESULTS, MEANS, minmax, _profiles(), WEIGHTED.replace("FROM normal", "FROM vals"), RANKED, select="SELECT profile, method, round(score, 6) AS score, rank, row_number() OVER (PARTITION BY profile ORDER BY score DESC, method) = 1 AS is_best FROM ranked"),
    }
