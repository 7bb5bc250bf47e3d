"""SQL for the result checks of the registered queries."""

from __future__ import annotations

# What the rules on names and values must say, written apart from the operators so that the two are compared.
TARGET_PARTS = (
    "target label class outcome result prediction approved success failure churned converted price value amount score rating revenue "
    "sales profit loss cost gone left"
).split()
REMOVAL_PARTS = "id index key uuid guid timestamp date_created created_at updated_at modified_at".split()
VALUE_RULES = """
    yes, no -> 2 -> Binary classification pattern detected: ['yes', 'no']
    true, false -> 2 -> Binary classification pattern detected: ['true', 'false']
    0, 1 -> 2 -> Binary classification pattern detected: ['0', '1']
    pass, fail -> 2 -> Binary classification pattern detected: ['pass', 'fail']
    approved, rejected -> 2 -> Binary classification pattern detected: ['approved', 'rejected']
    active, inactive -> 2 -> Binary classification pattern detected: ['active', 'inactive']
    on, off -> 2 -> Binary classification pattern detected: ['on', 'off']
    high, low -> 2 -> Binary classification pattern detected: ['high', 'low']
    good, bad -> 2 -> Binary classification pattern detected: ['good', 'bad']
    positive, negative -> 2 -> Binary classification pattern detected: ['positive', 'negative']
    low, medium, high -> 2 -> Ordinal pattern detected: ['low', 'medium', 'high']
    small, medium, large -> 2 -> Ordinal pattern detected: ['small', 'medium', 'large']
    poor, fair, good, excellent -> 2 -> Ordinal pattern detected: ['poor', 'fair', 'good', 'excellent']
    bad, average, good, excellent -> 2 -> Ordinal pattern detected: ['bad', 'average', 'good', 'excellent']
    never, rarely, sometimes, often, always -> 2 -> Ordinal pattern detected: ['never', 'rarely', 'sometimes', 'often', 'always']
    strongly disagree, disagree, neutral, agree, strongly agree -> 2 -> Ordinal pattern detected: ['strongly disagree', 'disagree', 'neutral', 'agree', 'strongly agree']
    beginner, intermediate, advanced -> 2 -> Ordinal pattern detected: ['beginner', 'intermediate', 'advanced']
    junior, senior -> 2 -> Ordinal pattern detected: ['junior', 'senior']
    first, second, third -> 2 -> Ordinal pattern detected: ['first', 'second', 'third']
    primary, secondary, tertiary -> 2 -> Ordinal pattern detected: ['primary', 'secondary', 'tertiary']
    xs, s, m, l, xl, xxl -> 1 -> Size classification detected (XS, S, M, L, XL, etc.)
    a, b, c, d, f -> 1 -> Grade/rating pattern detected (A, B, C, D, F)
"""
MONTH_NAMES = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec"
).split()
DAY_NAMES = "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun".split()


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def split_sql(source: str, row_id: str, seeds: list[int], label: str | None = None) -> str:
    """Every row of ``source`` per seed with ``is_test``: the ceil(0.3 n) smallest hashes, by class quota."""
    numbers = ", ".join(f"({s})" for s in seeds)
    cls = label or "0"
    return f"""
    base AS (SELECT *, {cls} AS cls_ FROM ({source})),
    sizes AS (SELECT cls_, count(*) AS n_ FROM base GROUP BY cls_),
    totals AS (SELECT sum(n_)::BIGINT AS n_all, ((3 * sum(n_) + 9) // 10)::BIGINT AS wanted FROM sizes),
    shares AS (SELECT cls_, (wanted * n_) // n_all AS whole, (wanted * n_) % n_all AS rest, wanted FROM sizes, totals),
    quota AS (
        SELECT cls_, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, cls_) <=
            wanted - sum(whole) OVER () THEN 1 ELSE 0 END AS quota_ FROM shares),
    ranked AS (
        SELECT base.*, seed, row_number() OVER (
            PARTITION BY seed, base.cls_ ORDER BY md5(seed || ':' || {row_id})) AS rank_
        FROM base, (VALUES {numbers}) AS s(seed)),
    split AS (SELECT ranked.* EXCLUDE (rank_), rank_ <= quota_ AS is_test FROM ranked JOIN quota USING (cls_))"""


def majority_scores_sql(source: str, row_id: str, label: str, seeds: list[int], stratify: bool) -> str:
    """CTEs ending in ``results(seed, score)``: accuracy of the majority class predictor."""
    return split_sql(source, row_id, seeds, label if stratify else None) + f""",
    tally AS (SELECT seed, {label} AS l, count(*) AS n FROM split WHERE NOT is_test GROUP BY ALL),
    learned AS (SELECT seed, l AS prediction FROM (
        SELECT *, row_number() OVER (PARTITION BY seed ORDER BY n DESC, l) AS k FROM tally) WHERE k = 1),
    results AS (
        SELECT seed, avg(CASE WHEN {label} = prediction THEN 1.0 ELSE 0.0 END) AS score
        FROM split JOIN learned USING (seed) WHERE is_test GROUP BY seed)"""


def mean_scores_sql(source: str, row_id: str, label: str, seeds: list[int], decimals: int) -> str:
    """CTEs ending in ``results(seed, score)``: rounded mean absolute error of the mean predictor."""
    return split_sql(source, row_id, seeds) + f""",
    learned AS (SELECT seed, avg({label}) AS prediction FROM split WHERE NOT is_test GROUP BY seed),
    results AS (
        SELECT seed, round(avg(abs({label} - prediction)), {decimals}) AS score
        FROM split JOIN learned USING (seed) WHERE is_test GROUP BY seed)"""


SUMMARY_TAIL = """
    modal AS (SELECT score AS common, n FROM (
        SELECT score, count(*) AS n, min(seed) AS f FROM results GROUP BY score) ORDER BY n DESC, f LIMIT 1),
    common AS (SELECT list(seed ORDER BY seed) AS seeds FROM results, modal WHERE score = common),
    best AS (SELECT seed AS best_seed, score AS best_score FROM results ORDER BY score {best}, seed LIMIT 1),
    worst AS (SELECT seed AS worst_seed, score AS worst_score FROM results ORDER BY score {worst}, seed LIMIT 1),
    spread AS (SELECT min(score) AS lo, max(score) AS hi, stddev_pop(score) AS sd, avg(score) AS mean FROM results)"""


def summary_ctes(higher: bool) -> str:
    return SUMMARY_TAIL.format(best="DESC" if higher else "ASC", worst="ASC" if higher else "DESC")


def categorical_rule_sql(values: str, count: str) -> tuple[str, str]:
    """``(type, reason)`` expressions over a list of distinct lower-cased values and their raw number."""
    rules: list[tuple[str, str]] = []

    def within(scale) -> str:
        return f"len(list_filter({values}, lambda v: NOT list_contains({listing(scale)}, v))) = 0"

    for line in VALUE_RULES.strip().splitlines():
        scale, least, reason = (part.strip() for part in line.split("->"))
        rules.append((f"{within(scale.split(', '))} AND len({values}) >= {least}", text(reason)))
    number = (
        r"^[+-]?(([0-9](_?[0-9])*)(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)(e[+-]?[0-9](_?[0-9])*)?$"
        r"|^[+-]?(inf|infinity|nan)$"
    )
    rules += [
        (f"len(list_filter({values}, lambda v: NOT regexp_matches(v, {text(number)}))) = 0", "'Numeric strings detected - likely ordinal'"),
        (within(MONTH_NAMES), "'Month names detected - chronological order'"),
        (within(DAY_NAMES), "'Day names detected - chronological order'"),
        (f"{count} = 2", "'Binary variable - assuming ordinal ordering'"),
        (f"{count} BETWEEN 3 AND 7", f"printf('Small number of categories (%d) - likely ordinal', {count})"),
    ]
    many = f"printf('Many categories (%d) - likely nominal', {count})"
    reason = "CASE " + " ".join(f"WHEN {test} THEN {why}" for test, why in rules) + f" ELSE {many} END"
    kind = "CASE " + " ".join(f"WHEN {test} THEN 'ordinal'" for test, _ in rules) + " ELSE 'nominal' END"
    return kind, reason


def suggestions_sql(source: str, columns: list[str], order_by: str) -> str:
    """One row per column of ``source`` with at most 20 values, with the verdict of the rules."""
    cells = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS variable_name, CAST({c} AS VARCHAR) AS v, {order_by} AS at_ FROM src"
        for i, c in enumerate(columns)
    )
    kind, reason = categorical_rule_sql("vals", "unique_count")
    return f"""
    WITH src AS ({source}), cells AS ({cells}),
    firsts AS (SELECT position, variable_name, v, min(at_) AS at_ FROM cells WHERE v IS NOT NULL GROUP BY ALL),
    lists AS (
        SELECT position, variable_name, list(v ORDER BY at_, v) AS shown, count(*) AS unique_count,
            list_distinct(list(lower(trim(v)))) AS vals
        FROM firsts GROUP BY ALL HAVING count(*) <= 20)
    SELECT variable_name, {kind} AS suggested_type, array_to_string(shown, '|') AS unique_values, unique_count,
        {reason} AS reasoning FROM lists"""


def profile_sql(source: str, columns: list[tuple[str, str]]) -> str:
    """``(column_name, position, kind, rows, missing, distinct_count, distinct_ratio, is_zero_one)``."""
    rows = []
    for i, (name, kind) in enumerate(columns):
        zero_one = f"(count(DISTINCT {name}) = 2 AND coalesce(bool_and({name} IN (0, 1)), false))" if kind == "numeric" else "false"
        rows.append(
            f"SELECT '{name}' AS column_name, {i} AS position, '{kind}' AS kind, count(*) AS rows, "
            f"count(*) - count({name}) AS missing, count(DISTINCT {name}) AS distinct_count, "
            f"CASE WHEN count(*) > 0 THEN count(DISTINCT {name}) / count(*) ELSE 0 END AS distinct_ratio, "
            f"{zero_one} AS is_zero_one FROM {source}"
        )
    return " UNION ALL ".join(rows)


def names_like(parts) -> str:
    return "(" + " OR ".join(f"contains(lower(column_name), {text(p)})" for p in parts) + ")"


def line_comparison_sql(roles: str, source: str, row_id: str, x: str, y: str, folds: int) -> str:
    """CTEs ending in ``board(seed_role, seed, model, mae, rmse, r2)``: cross-validated one-predictor line and mean.

    ``roles`` selects ``(seed_role, seed)``; the smallest 30 % of a seed's hashes are left out, the rest falls into folds.
    """
    return f"""
    roles_ AS ({roles}), src_ AS ({source}),
    ranked_ AS (SELECT seed_role, seed, {x} AS x, {y} AS y,
        row_number() OVER (PARTITION BY seed_role ORDER BY md5(seed || ':' || {row_id})) AS rk,
        count(*) OVER (PARTITION BY seed_role) AS n FROM src_, roles_),
    sized_ AS (SELECT *, (3 * n + 9) // 10 AS held, n - (3 * n + 9) // 10 AS training FROM ranked_),
    folded_ AS (SELECT *, (SELECT min(f) FROM range(1, {folds + 1}) g(f) WHERE rk <= held + training * f // {folds}) AS fold
        FROM sized_ WHERE rk > held),
    learned_ AS (SELECT seed_role, f, regr_slope(y, x) AS slope, avg(y) AS my, avg(x) AS mx
        FROM folded_, range(1, {folds + 1}) g(f) WHERE fold <> f GROUP BY ALL),
    guessed_ AS (SELECT p.seed_role, seed, fold, y, my + slope * (x - mx) AS line, my AS flat
        FROM folded_ p JOIN learned_ l ON p.seed_role = l.seed_role AND p.fold = l.f),
    both_ AS (SELECT seed_role, seed, fold, y, 'Linear Regression' AS model, line AS guess FROM guessed_
        UNION ALL SELECT seed_role, seed, fold, y, 'Baseline', flat FROM guessed_),
    scored_ AS (SELECT seed_role, seed, fold, model, avg(abs(y - guess)) AS mae, sqrt(avg((y - guess) ** 2)) AS rmse,
        1 - sum((y - guess) ** 2) / (var_pop(y) * count(*)) AS r2 FROM both_ GROUP BY ALL),
    board AS (SELECT seed_role, seed, model, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2 FROM scored_ GROUP BY ALL)"""


def nearest_sql(source: str, row_id: str, distance: str, asked: str, same_class: bool, k: int) -> str:
    """CTE body: the k nearest rows of every asked row, by squared distance, then id."""
    match = "AND q.label = p.label" if same_class else ""
    return f"""
        SELECT * FROM (
            SELECT q.{row_id} AS id, p.{row_id} AS other, q.label AS label, p.label AS other_label,
                row_number() OVER (PARTITION BY q.{row_id} ORDER BY {distance}, p.{row_id}) AS place
            FROM {source} q JOIN {source} p ON q.{row_id} <> p.{row_id} {match}
            WHERE q.label IN ({asked})) WHERE place <= {k}"""


def unit_sql(seed: int, *parts: str) -> str:
    joined = " || ':' || ".join([f"'{seed}'", *parts])
    return f"(('0x' || substr(md5({joined}), 1, 13))::BIGINT / 4503599627370496.0)"


def linear_imputation_sql(source: str, row_id: str, a: str, b: str, rounds: int, tolerance: str) -> str:
    """Two columns whose gaps are predicted from each other in turn, fewest gaps first, until nothing moves by the tolerance."""
    def fit(rows: str, y: str, x: str) -> str:
        return f"(SELECT regr_slope({y}, {x}) AS slope, avg({x}) AS mx, avg({y}) AS my FROM {rows} WHERE {y} IS NOT NULL)"

    steps = [f"""
    g AS MATERIALIZED (SELECT {row_id} AS id, {a} AS a, {b} AS b FROM ({source})),
    o AS MATERIALIZED (SELECT count(a) >= count(b) AS a_first, {tolerance} * greatest(max(abs(a)), max(abs(b))) AS least, avg(a) AS ma, avg(b) AS mb FROM g),
    s0 AS MATERIALIZED (SELECT id, a, b, coalesce(a, ma) AS x, coalesce(b, mb) AS y, true AS live FROM g, o)"""]
    for k in range(rounds):
        steps.append(f"""
    u{k} AS MATERIALIZED (SELECT s.*, CASE WHEN a_first THEN coalesce(a, fa.my + fa.slope * (y - fa.mx)) ELSE x END AS x1,
        CASE WHEN a_first THEN y ELSE coalesce(b, fb.my + fb.slope * (x - fb.mx)) END AS y1
        FROM s{k} s, o, {fit(f's{k}', 'a', 'y')} fa, {fit(f's{k}', 'b', 'x')} fb),
    v{k} AS MATERIALIZED (SELECT u.*, CASE WHEN a_first THEN x1 ELSE coalesce(a, fa.my + fa.slope * (y1 - fa.mx)) END AS x2,
        CASE WHEN a_first THEN coalesce(b, fb.my + fb.slope * (x1 - fb.mx)) ELSE y1 END AS y2
        FROM u{k} u, o, {fit(f'u{k}', 'a', 'y1')} fa, {fit(f'u{k}', 'b', 'x1')} fb),
    s{k + 1} AS MATERIALIZED (SELECT id, a, b, CASE WHEN live THEN x2 ELSE x END AS x, CASE WHEN live THEN y2 ELSE y END AS y,
        live AND moved >= least AS live FROM v{k}, o, (SELECT max(greatest(abs(x2 - x), abs(y2 - y))) AS moved FROM v{k}))""")
    return f"WITH {','.join(steps)} SELECT id AS {row_id}, round(x, 6) AS {a}, round(y, 6) AS {b} FROM s{rounds}"


def class_folds_sql(source: str, row_id: str, seed: int, label: str, folds: int) -> str:
    """CTEs ending in ``folded_``: the training rows of a seed's split by class, with ``fold``."""
    return split_sql(source, row_id, [seed], label) + f""",
    placed_ AS (SELECT r.*, quota_, n_ - quota_ AS training FROM ranked r JOIN quota USING (cls_) JOIN sizes USING (cls_)),
    folded_ AS (SELECT *, (SELECT min(f) FROM range(1, {folds + 1}) g(f) WHERE rank_ <= quota_ + training * f // {folds}) AS fold
        FROM placed_ WHERE rank_ > quota_)"""


def discriminants_sql(source: str, row_id: str, seed: int, x: str, y: str, label: str, folds: int) -> str:
    """CTEs ending in ``board(model, accuracy, precision, recall, f1)`` of normal densities in two features, by fold.

    Covariances are written out for two dimensions: one per class, one for both, or variances alone.
    """
    return class_folds_sql(source, row_id, seed, label, folds) + f""",
    own_ AS (SELECT f, {label} AS c, count(*)::DOUBLE AS n, avg({x}) AS mx, avg({y}) AS my, var_pop({x}) AS vx, var_pop({y}) AS vy, covar_pop({x}, {y}) AS cxy
        FROM folded_, range(1, {folds + 1}) g(f) WHERE fold <> f GROUP BY ALL),
    both_ AS (SELECT f, sum(n) AS rows, count(*) AS classes, sum(n * vx) AS sx, sum(n * vy) AS sy, sum(n * cxy) AS sxy FROM own_ GROUP BY f),
    wide_ AS (SELECT f, greatest(var_pop({x}), var_pop({y})) * 1e-9 AS least FROM folded_, range(1, {folds + 1}) g(f) WHERE fold <> f GROUP BY f),
    shapes_ AS (
        SELECT 'Quadratic Discriminant Analysis' AS model, f, c, n, mx, my, vx * n / (n - 1) AS a, vy * n / (n - 1) AS b, cxy * n / (n - 1) AS k FROM own_
        UNION ALL SELECT 'Linear Discriminant Analysis', f, c, n, mx, my, sx / (rows - classes), sy / (rows - classes), sxy / (rows - classes) FROM own_ JOIN both_ USING (f)
        UNION ALL SELECT 'Naive Bayes', f, c, n, mx, my, vx + least, vy + least, 0 FROM own_ JOIN wide_ USING (f)),
    scored_ AS (SELECT model, fold, {row_id} AS id, {label} AS y, c, ln(n) - 0.5 * ln(a * b - k * k)
            - 0.5 * (b * ({x} - mx) ** 2 - 2 * k * ({x} - mx) * ({y} - my) + a * ({y} - my) ** 2) / (a * b - k * k) AS score
        FROM folded_ JOIN shapes_ ON fold = f),
    said_ AS (SELECT model, fold, y, arg_max(c, (score, -c)) AS guess FROM scored_ GROUP BY model, fold, id, y),
    hits_ AS (SELECT model, fold, count(*) FILTER (y = guess) AS hit, count(*) AS n, count(*) FILTER (y = 1 AND guess = 1) AS tp,
        count(*) FILTER (y = 1) AS pos, count(*) FILTER (guess = 1) AS claimed FROM said_ GROUP BY ALL),
    board AS (SELECT model, avg(hit / n) AS accuracy, avg(coalesce(tp / nullif(claimed, 0), 0)) AS precision, avg(coalesce(tp / nullif(pos, 0), 0)) AS recall,
        avg(coalesce(2 * tp / nullif(pos + claimed, 0), 0)) AS f1 FROM hits_ GROUP BY model)"""


def _cut_points_sql(source: str, features: list[str], by: str = "1") -> str:
    """(grp, feature, position, cut): half way between neighbouring values of each feature."""
    values = " UNION ALL ".join(f"SELECT DISTINCT {by} AS grp, {i} AS position, '{x}' AS feature, {x}::DOUBLE AS v FROM {source}" for i, x in enumerate(features))
    return f"SELECT grp, feature, position, (v + lead(v) OVER (PARTITION BY grp, position ORDER BY v)) / 2 AS cut FROM ({values}) QUALIFY cut IS NOT NULL"


def stump_scores_sql(source: str, row_id: str, seeds: list[int], features: list[str], label: str) -> str:
    """CTEs ending in ``results(seed, score)``: root mean squared error of the best single split by squared error."""
    value = "CASE position " + " ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(features)) + " END"
    return split_sql(source, row_id, seeds) + f""",
    cells AS (SELECT seed, {', '.join(features)}, count(*) AS n, sum({label}) AS s FROM split WHERE NOT is_test GROUP BY ALL),
    cuts AS ({_cut_points_sql('split', features)}),
    sides AS (SELECT seed, feature, position, cut, sum(n) FILTER ({value} <= cut) AS nl, sum(s) FILTER ({value} <= cut) AS sl,
        sum(n) FILTER ({value} > cut) AS nr, sum(s) FILTER ({value} > cut) AS sr FROM cells, cuts GROUP BY ALL),
    best AS (SELECT * FROM sides WHERE nl > 0 AND nr > 0 QUALIFY row_number() OVER (
        PARTITION BY seed ORDER BY round((sl * sl / nl + sr * sr / nr) / 1e6, 3) DESC, position, cut) = 1),
    results AS (SELECT seed, sqrt(avg(({label} - CASE WHEN {value} <= cut THEN sl / nl ELSE sr / nr END) ** 2)) AS score
        FROM split JOIN best USING (seed) WHERE is_test GROUP BY seed)"""


def reweighted_stumps_sql(source: str, features: list[str], label: str, rounds: int) -> str:
    """CTEs ending in ``rounds(round, feature, threshold, counts)``: two-class boosting with a weight per cell, stored round by round."""
    value = "CASE position " + " ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(features)) + " END"
    names = ", ".join(features)
    ctes = [f"""rows_ AS ({source}), cuts AS ({_cut_points_sql('rows_', features)}),
    w1 AS (SELECT {names}, {label} AS y, count(*)::DOUBLE AS w FROM rows_ GROUP BY ALL)"""]
    for k in range(1, rounds + 1):
        ctes.append(f"""sides{k} AS (SELECT feature, position, cut, coalesce(sum(w) FILTER ({value} <= cut AND y = 0), 0) AS l0, coalesce(sum(w) FILTER ({value} <= cut AND y = 1), 0) AS l1,
        coalesce(sum(w) FILTER ({value} > cut AND y = 0), 0) AS r0, coalesce(sum(w) FILTER ({value} > cut AND y = 1), 0) AS r1 FROM w{k}, cuts GROUP BY ALL),
    best{k} AS (SELECT *, least(l0, l1) + least(r0, r1) AS missed, l0 + l1 + r0 + r1 AS total, (l1 > l0)::INT AS low, (r1 > r0)::INT AS high FROM sides{k}
        QUALIFY row_number() OVER (ORDER BY round(((l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)) / (l0 + l1 + r0 + r1), 12) DESC, position, cut) = 1),
    w{k + 1} AS (SELECT {names}, y, w * CASE WHEN y = CASE WHEN {value} <= cut THEN low ELSE high END THEN 1 ELSE (total - missed) / missed END AS w FROM w{k}, best{k})""")
    board = " UNION ALL ".join(f"SELECT {k} AS round, feature, cut AS threshold, ln((total - missed) / missed) AS counts FROM best{k}" for k in range(1, rounds + 1))
    return ", ".join(ctes) + f", rounds AS ({board})"
