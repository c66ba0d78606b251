"""``oracles()``: query name to SQL text."""

from __future__ import annotations

from checks import sql as q
from checks.rounding import sql_fixed as r
from checks.rounding import sql_significant as sig

NB = q.NB_COLUMNS
PREDICTORS = ("med_inc", "yr_built", "ave_elev")


def _columns(*names: str, **rounded: str) -> str:
    return ", ".join([*names, *[f"{r(x)} AS {name}" for name, x in rounded.items()]])


def _r(*names: str) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


def _responses() -> str:
    """Long (response, y, x1, x2, x3) of every neighbourhood-level response."""
    tables = {
        "nb_genus": ("flow_rich", "flow_even"),
        "nb_totals": (
            "flowers", "plants", "m_sd_size", "m_var_size", "area", "natives_abun", "m_water",
        ),
        "nb_traits": ("m_cols", "m_inflor", "m_sym", "m_sd"),
        "nb_natives": ("natf_rich",),
        "nb_lawn_div": ("l_richness", "l_evenness"),
        "nb_lawn_natives": ("nat_rich_mer", "nat_cover_mer"),
    }
    parts = [
        f"SELECT '{y}' AS response, CAST({y} AS DOUBLE) AS y, med_inc AS x1, yr_built AS x2, "
        f"ave_elev AS x3 FROM {table} LEFT JOIN nb_info USING (nb)"
        for table, ys in tables.items()
        for y in ys
    ]
    return f"responses AS ({' UNION ALL '.join(parts)})"


def _normal_equations(source: str, by: str) -> str:
    """Three-predictor least squares by cofactors of the centred cross-products."""
    pairs = [("x1", "x1"), ("x1", "x2"), ("x1", "x3"), ("x2", "x2"), ("x2", "x3"), ("x3", "x3")]
    s = ", ".join(
        f"sum(({a} - m_{a}) * ({b} - m_{b})) AS {a}{b}"
        for a, b in [*pairs, ("x1", "y"), ("x2", "y"), ("x3", "y"), ("y", "y")]
    )
    means = ", ".join(f"avg({v}) OVER (PARTITION BY {by}) AS m_{v}" for v in ("x1", "x2", "x3", "y"))
    return f"""
complete AS (SELECT *, {means} FROM {source}
             WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL),
cross_sums AS (SELECT {by}, CAST(count(*) AS DOUBLE) AS n, any_value(m_x1) AS m1,
  any_value(m_x2) AS m2, any_value(m_x3) AS m3, any_value(m_y) AS my, {s}
  FROM complete GROUP BY {by}),
cofactors AS (SELECT *, x2x2 * x3x3 - x2x3 * x2x3 AS c11, x1x3 * x2x3 - x1x2 * x3x3 AS c12,
  x1x2 * x2x3 - x1x3 * x2x2 AS c13, x1x1 * x3x3 - x1x3 * x1x3 AS c22,
  x1x2 * x1x3 - x1x1 * x2x3 AS c23, x1x1 * x2x2 - x1x2 * x1x2 AS c33 FROM cross_sums),
inverse AS (SELECT *, x1x1 * c11 + x1x2 * c12 + x1x3 * c13 AS det FROM cofactors),
slopes AS (SELECT *, (c11 * x1y + c12 * x2y + c13 * x3y) / det AS b1,
  (c12 * x1y + c22 * x2y + c23 * x3y) / det AS b2,
  (c13 * x1y + c23 * x2y + c33 * x3y) / det AS b3 FROM inverse),
solved AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0,
  yy - b1 * x1y - b2 * x2y - b3 * x3y AS sse, n - 4 AS df FROM slopes),
terms AS (
  SELECT {by}, '(intercept)' AS term, b0 AS estimate, sqrt(sse / df * (1 / n + (m1 * m1 * c11
    + m2 * m2 * c22 + m3 * m3 * c33 + 2 * m1 * m2 * c12 + 2 * m1 * m3 * c13
    + 2 * m2 * m3 * c23) / det)) AS std_error, df FROM solved
  UNION ALL SELECT {by}, '{{x1}}', b1, sqrt(sse / df * c11 / det), df FROM solved
  UNION ALL SELECT {by}, '{{x2}}', b2, sqrt(sse / df * c22 / det), df FROM solved
  UNION ALL SELECT {by}, '{{x3}}', b3, sqrt(sse / df * c33 / det), df FROM solved)"""


def _terms(by: str, names: tuple[str, str, str]) -> str:
    return _normal_equations("responses", by).format(x1=names[0], x2=names[1], x3=names[2])


def _term_columns(by: str) -> str:
    t = "(estimate / std_error)"
    partial = f"CASE WHEN term <> '(intercept)' THEN {t} * {t} / ({t} * {t} + df) END"
    return (
        f"SELECT {by}, term, {sig('estimate')} AS estimate, {sig('std_error')} AS std_error, "
        f"{r(t)} AS t, CAST(df AS BIGINT) AS df, {r(partial)} AS partial_r2, "
        f"{r(q.t_tail(t, 'df'))} AS p_value FROM terms"
    )


def _fit_columns(by: str) -> str:
    f = "(((yy - sse) / 3) / (sse / df))"
    return (
        f"SELECT {by}, CAST(n AS BIGINT) AS n, {r('1 - sse / yy')} AS r2, "
        f"{r('1 - (sse / df) / (yy / (n - 1))')} AS adj_r2, {sig('sqrt(sse / df)')} AS sigma, "
        f"3 AS df_model, CAST(df AS BIGINT) AS df_residual, {r(f)} AS f, "
        f"{r(q.f_tail(f, '3.0', 'df'))} AS p_value FROM solved"
    )


INTERACTION_INPUTS = """
inputs AS (
  SELECT 'layer richness' AS comparison, med_inc AS x, variable AS g, num_species AS y
  FROM nb_layers LEFT JOIN nb_info USING (nb)
  UNION ALL SELECT 'lawn type richness', med_inc_short, type, type_mean FROM nb_types
  UNION ALL SELECT 'yard side richness', med_inc, front_back, richness
  FROM nb_sides LEFT JOIN nb_info USING (nb)
  UNION ALL SELECT 'yard side colours', med_inc, front_back, m_cols
  FROM nb_sides LEFT JOIN nb_info USING (nb))"""


def _anova(source: str, by: str) -> str:
    """Sequential sums of squares from centred sums, two-level or wider factor."""
    return f"""
usable AS (SELECT * FROM {source} WHERE x IS NOT NULL AND g IS NOT NULL AND y IS NOT NULL),
overall_fit AS (SELECT {by}, count(*) AS n, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
  regr_sxy(y, x) AS sxy, avg(x) AS o_mx, avg(y) AS o_my FROM usable GROUP BY {by}),
group_fit AS (SELECT {by}, g, count(*) AS gn, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS gxx,
  regr_syy(y, x) AS gyy, regr_sxy(y, x) AS gxy FROM usable GROUP BY {by}, g),
within_fit AS (SELECT {by}, count(*) AS k, sum(gxx) AS wxx, sum(gxy) AS wxy,
  sum(gyy - gxy * gxy / gxx) AS sse_full FROM group_fit GROUP BY {by}),
-- residuals of each fit in turn, so that no large sums are subtracted
steps AS (SELECT {by}, any_value(n - 2 * k) AS df_residual, any_value(k) AS k,
  any_value(sse_full) AS sse_full, any_value(sxy * sxy / sxx) AS ss_x,
  any_value(pow(sxy / sxx - wxy / wxx, 2) * wxx)
    + sum(gn * pow(my - o_my - sxy / sxx * (mx - o_mx), 2)) AS ss_g,
  sum(gxx * pow(gxy / gxx - wxy / wxx, 2)) AS ss_xg
  FROM group_fit JOIN within_fit USING ({by}) JOIN overall_fit USING ({by}) GROUP BY {by}),
table_rows AS (
  SELECT {by}, 1 AS position, '{{x}}' AS term, 1 AS df, ss_x AS ss, sse_full, df_residual FROM steps
  UNION ALL SELECT {by}, 2, '{{g}}', k - 1, ss_g, sse_full, df_residual FROM steps
  UNION ALL SELECT {by}, 3, '{{x}}:{{g}}', k - 1, ss_xg, sse_full, df_residual FROM steps
  UNION ALL SELECT {by}, 4, 'residuals', df_residual, sse_full, NULL, df_residual FROM steps)"""


def _anova_columns(by: str) -> str:
    f = "((ss / df) / (sse_full / df_residual))"
    return (
        f"SELECT {by}, position, term, CAST(df AS BIGINT) AS df, {sig('ss')} AS ss, "
        f"{sig('ss / df')} AS ms, {sig(f)} AS f, "
        f"{r(q.f_tail(f, 'df', 'df_residual'))} AS p_value FROM table_rows"
    )


def _interaction_terms() -> str:
    return f"""
SELECT comparison, term, {sig('estimate')} AS estimate, {sig('std_error')} AS std_error,
  {r('estimate / std_error')} AS t, CAST(df_residual AS BIGINT) AS df,
  {r(q.t_tail('(estimate / std_error)', 'df_residual'))} AS p_value
FROM (
  SELECT *, sqrt(sse_full / df_residual * unit) AS std_error FROM (
    SELECT comparison, '(intercept)' AS term, a0 AS estimate, va0 AS unit FROM base
    UNION ALL SELECT comparison, 'income', b0, vb0 FROM base
    UNION ALL SELECT comparison, 'grouping' || g, a - a0, va + va0
    FROM lines JOIN base USING (comparison) WHERE g <> g0
    UNION ALL SELECT comparison, 'income:grouping' || g, b - b0, vb + vb0
    FROM lines JOIN base USING (comparison) WHERE g <> g0)
  JOIN steps USING (comparison))"""


LINES = """
lines AS (SELECT comparison, g, gxy / gxx AS b, my - gxy / gxx * mx AS a,
            1 / gn + mx * mx / gxx AS va, 1 / gxx AS vb FROM group_fit),
base AS (SELECT comparison, g AS g0, a AS a0, b AS b0, va AS va0, vb AS vb0 FROM lines
         WHERE (comparison, g) IN (VALUES ('layer richness', 'Lawn species'),
           ('lawn type richness', 'Turfgrasses'), ('yard side richness', 'Back'),
           ('yard side colours', 'Back')))"""


def _importance() -> str:
    labels = {
        "a6": "Natives", "a7": "Variety", "a8": "Biodiversity", "a901": "Leaf Color",
        "a902": "Flower Color", "a903": "Flower Type", "a904": "Plant Shape",
        "a905": "Plant Height", "a906": "Seasonal Color", "a907": "Leaf Texture",
        "a908": "Plant Type", "a909": "A909", "a910": "Ornamental Species", "nb": "NB",
    }
    parts = " UNION ALL ".join(
        f"SELECT '{label}' AS variable, TRY_CAST({c} AS DOUBLE) AS v FROM survey"
        for c, label in labels.items()
    )
    return f"""
answers AS ({parts}),
importance AS (SELECT variable, avg(v) AS importance, stddev_samp(v) AS sd, count(v) AS n,
               stddev_samp(v) / sqrt(count(v)) AS se FROM answers GROUP BY variable)"""


def _attitude(item: str, n: str) -> str:
    return f"""
attitude_{item} AS (
  SELECT nb, avg(TRY_CAST({item} AS DOUBLE)) AS mean_{item},
    stddev_samp(TRY_CAST({item} AS DOUBLE)) AS sd, {n} AS n
  FROM survey WHERE house_id <> '110_2_1' GROUP BY nb)"""


def _pearson_columns(by: str, source: str) -> str:
    t = "(r * sqrt((n - 2) / (1 - r * r)))"
    reach = "(1.959963984540054 / sqrt(n - 3))"
    return f"""
SELECT {by}, n, {r('r')} AS r, {r(t)} AS t, n - 2 AS df, {r(q.t_tail(t, '(n - 2)'))} AS p_value,
  {r(f'tanh(atanh(r) - {reach})')} AS conf_low, {r(f'tanh(atanh(r) + {reach})')} AS conf_high
FROM {source}"""


def _kendall(source: str, by: str) -> str:
    """tau-b from every pair of distinct (x, y) cells."""
    return f"""
tau_cells AS (SELECT {by}, x, y, count(*) AS w FROM {source}
              WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY {by}, x, y),
scores AS (SELECT a.{by}, CAST(sum(CAST(sign(b.y - a.y) AS BIGINT) * a.w * b.w) AS DOUBLE) AS s
           FROM tau_cells a JOIN tau_cells b ON a.{by} = b.{by} AND a.x < b.x GROUP BY 1),
x_ties AS (SELECT {by}, sum(t * (t - 1)) AS p, sum(t * (t - 1) * (2 * t + 5)) AS v,
             sum(t * (t - 1) * (t - 2)) AS c
           FROM (SELECT {by}, x, CAST(sum(w) AS DOUBLE) AS t FROM tau_cells GROUP BY 1, 2)
           GROUP BY 1),
y_ties AS (SELECT {by}, sum(t * (t - 1)) AS p, sum(t * (t - 1) * (2 * t + 5)) AS v,
             sum(t * (t - 1) * (t - 2)) AS c
           FROM (SELECT {by}, y, CAST(sum(w) AS DOUBLE) AS t FROM tau_cells GROUP BY 1, 2)
           GROUP BY 1),
tau_parts AS (
  SELECT {by}, n, s, s / (sqrt((n * (n - 1) - x.p) * (n * (n - 1) - y.p)) / 2) AS tau,
    s / sqrt((n * (n - 1) * (2 * n + 5) - x.v - y.v) / 18 + x.p * y.p / (2 * n * (n - 1))
      + x.c * y.c / (9 * n * (n - 1) * (n - 2))) AS z
  FROM (SELECT {by}, CAST(sum(w) AS DOUBLE) AS n FROM tau_cells GROUP BY 1)
  JOIN scores USING ({by}) JOIN x_ties x USING ({by}) JOIN y_ties y USING ({by}))
SELECT {by}, CAST(n AS BIGINT) AS n, s, {r('tau')} AS tau, {r('z')} AS z,
  {r(q.normal_tail('z'))} AS p_value FROM tau_parts"""


DIRECT = """
direct AS (
  SELECT s.house_id, TRY_CAST(a6 AS DOUBLE) AS a6, TRY_CAST(a8 AS DOUBLE) AS a8,
    TRY_CAST(a902 AS DOUBLE) AS a902,
    (TRY_CAST(a901 AS DOUBLE) + TRY_CAST(a903 AS DOUBLE) + TRY_CAST(a905 AS DOUBLE)) / 3
      AS watercons,
    CAST(color_num AS DOUBLE) AS color_num_f, CAST(genera_num AS DOUBLE) AS rich_flowers,
    CAST(natives_rich AS DOUBLE) AS natives_rich_f, water_wghtd_avg,
    native_cover AS native_cover_l
  FROM survey s JOIN house_traits t USING (house_id) JOIN house_natives n USING (house_id)
  JOIN house_totals w USING (house_id) LEFT JOIN lawn_natives l USING (house_id))"""

DIRECT_TABLES = (
    q.OBS, q.LAWN, q.SURVEY, q.HOUSE_TOTALS, q.TRAITS, q.NATIVES, q.LAWN_NATIVES, DIRECT,
)
PREFERENCES = """
preferences AS (
  SELECT 'a902 ~ color_num_f' AS comparison, a902 AS x, color_num_f AS y FROM direct
  UNION ALL SELECT 'a8 ~ rich_flowers', a8, rich_flowers FROM direct
  UNION ALL SELECT 'a6 ~ natives_rich_f', a6, natives_rich_f FROM direct
  UNION ALL SELECT 'watercons ~ water_wghtd_avg', watercons, water_wghtd_avg FROM direct
  UNION ALL SELECT 'a6 ~ native_cover_l', a6, native_cover_l FROM direct)"""

REGRESSION_TABLES = (
    q.NB_INFO, q.OBS, q.LAWN, q.HOUSE_TOTALS, q.NB_TOTALS, q.GENUS, q.TRAITS, q.NATIVES,
    q.LAWN_DIVERSITY, q.LAWN_NATIVES, _responses(), _terms("response", PREDICTORS),
)
INTERACTION_TABLES = (
    q.NB_INFO, q.OBS, q.LAWN, q.GENUS, q.TRAITS, q.SIDES, q.LAWN_RICHNESS, q.LAYERS, q.TYPES,
    INTERACTION_INPUTS, _anova("inputs", "comparison").format(x="income", g="grouping"),
)


def _trend(source: str, x: str, y: str, se: str, x_limits=None, y_limits=None, group=None) -> str:
    """Points inside the limits and the line fitted to them."""
    series = group or "'all'"
    where = [f"{x} IS NOT NULL", f"{y} IS NOT NULL"]
    where += [f"{x} BETWEEN {x_limits[0]} AND {x_limits[1]}"] if x_limits else []
    where += [f"{y} BETWEEN {y_limits[0]} AND {y_limits[1]}"] if y_limits else []
    return f"""
shown AS (SELECT {series} AS series, {x} AS x, {y} AS y, {se} AS se FROM {source}
          WHERE {' AND '.join(where)}),
fitted AS (SELECT series, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept
           FROM shown GROUP BY series)
SELECT series, {r('x')} AS x, {r('y')} AS y, {r('se')} AS se, {r('y - se')} AS lower,
  {r('y + se')} AS upper, {sig('slope')} AS slope, {sig('intercept')} AS intercept
FROM shown LEFT JOIN fitted USING (series)"""


def _comma(*parts: str) -> str:
    """Join table definitions whose last one already carries the final SELECT."""
    return "WITH " + ",".join(parts)


def taxa() -> list[str]:
    """Brand x type labels of the wide floral table."""
    types = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
    return [f"Brand#{b}_{t}" for b in range(1, 26) for t in types]


def lawn_taxa() -> list[str]:
    """Species labels of the wide lawn table, with the not-collected code."""
    priorities = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    species = [
        f"{s}-{p}-{y}"
        for s in "FOP"
        for p in priorities
        for y in range(1995, 2002)
        if (s, p) != ("P", "5-LOW")
    ]
    return [*species, "Not collected"]


def _wide(keys: str, labels: list[str]) -> str:
    cells = ", ".join(
        f"{r(f'''coalesce(max(CASE WHEN taxon = '{t}' THEN abundance END), 0.0)''')} AS \"{t}\""
        for t in labels
    )
    return f"SELECT {keys}, {cells} FROM community GROUP BY {keys}"


FACTORS = ["nb", "nb_age", "nb_inc"]
DISPERSION_FACTORS = ["nb_inc", "nb_age"]


# What must not be found in an ordination.
NMDS_ABSENT = (
    "starts that did not converge", "axes off centre", "axes correlated", "axes out of order",
    "values with two levels", "levels off their mean", "levels that should part", "levels that fall",
    "stress off", "unit off",
)


def _community(which: str) -> tuple[str, ...]:
    if which == "floral":
        return q.NB_INFO, q.OBS, q.FLORAL_COMMUNITY
    return q.NB_INFO, q.LAWN, q.LAWN_COMMUNITY


def _community_oracles(which: str, permutations: int) -> dict[str, str]:
    base = (*_community(which), q.PAIRS)
    tested = (*base, q.labels(FACTORS))
    spread = (*base, q.labels(DISPERSION_FACTORS), q.DISPERSION)
    p_value = f"(coalesce(exceed, 0) + 1) / {permutations + 1}.0"
    return {
        f"{which}_bray_curtis": q.query(
            *base, final=f"SELECT site_i, site_j, {r('d')} AS d FROM pairs"
        ),
        f"{which}_nmds_checks": q.query(
            *tested,
            final=f"""SELECT 'sites' AS check_name, count(*) AS n FROM sites
              UNION ALL SELECT 'pairs', count(d) FROM pairs
              UNION ALL SELECT 'centroids', count(*) FROM (SELECT DISTINCT nb, nb_inc FROM sites)
              UNION ALL SELECT unnest({list(NMDS_ABSENT)}), 0""",
        ),
        f"{which}_permanova_stat": q.query(
            *tested, q.PERMANOVA, final=f"SELECT {q.PERMANOVA_COLUMNS} FROM fit"
        ),
        f"{which}_permanova_perm": q.query(
            *tested,
            q.PERMANOVA,
            q.shuffles(permutations),
            q.permanova_permuted(permutations),
            final=f"""SELECT {q.PERMANOVA_COLUMNS}, {permutations} AS permutations,
              {r(p_value)} AS p_value FROM fit JOIN exceed USING (factor)""",
        ),
        f"{which}_dispersion": q.query(
            *spread, final=f"SELECT factor, label, site, {r('z')} AS z FROM z"
        ),
        f"{which}_dispersion_groups": q.query(
            *spread,
            final=f"""SELECT factor, label, count(*) AS n, {r('avg(z)')} AS mean_z
              FROM z GROUP BY factor, label""",
        ),
        f"{which}_dispersion_perm": q.query(
            *spread,
            q.shuffles(permutations),
            q.dispersion_permuted(),
            final=f"""SELECT factor, k - 1 AS df_between, n - k AS df_within,
              {r('ss_between')} AS ss_between, {r('ss_within')} AS ss_within, {r('f')} AS f,
              {permutations} AS permutations, {r(p_value)} AS p_value
              FROM fit JOIN exceed USING (factor)""",
        ),
    }


def _color_area() -> str:
    return q.query(
        q.NB_INFO,
        q.OBS,
        """
split AS (
  SELECT nb_inc, color1 AS color,
    CASE WHEN color2 <> '' THEN 0.5 * total_flower_area WHEN color2 = '' THEN total_flower_area
    END AS area
  FROM obs LEFT JOIN nb_info USING (nb) WHERE color1 NOT IN ('NoFlowers', 'NoPhoto')
  UNION ALL
  SELECT nb_inc, color2, 0.5 * total_flower_area
  FROM obs LEFT JOIN nb_info USING (nb) WHERE color1 NOT IN ('NoFlowers', 'NoPhoto')
    AND color2 <> ''),
summed AS (SELECT color, nb_inc, coalesce(sum(area), 0.0) AS color_area FROM split
           WHERE color <> '' AND color <> 'brown' GROUP BY color, nb_inc)""",
        final=f"""SELECT CASE WHEN list_position({q.COLORS}[1:11], color) > 0 THEN color END AS color,
  CAST(nullif(list_position({q.COLORS}[1:11], color), 0) AS INT) AS color_rank,
  CASE nb_inc WHEN 'low' THEN 'Low' WHEN 'mid' THEN 'Mid' WHEN 'high' THEN 'High' END AS income,
  CASE nb_inc WHEN 'low' THEN 1 WHEN 'mid' THEN 2 WHEN 'high' THEN 3 END AS income_rank,
  {r('color_area')} AS color_area FROM summed""",
    )


def _large() -> dict[str, str]:
    """Operators run over the big tables as they are."""
    nulls = "nullif(l_discount, 0.0)"
    pearson_source = """
moments AS (SELECT c_nationkey, count(*) AS n, corr(o_totalprice, c_acctbal) AS r
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)"""
    responses = """
responses AS (SELECT l_returnflag || l_linestatus AS grp, l_extendedprice AS y, l_quantity AS x1,
                l_discount AS x2, l_tax AS x3 FROM lineitem)"""
    priced = """
inputs AS (SELECT l_returnflag AS flag, l_quantity AS x, l_linestatus AS g, l_extendedprice AS y
           FROM lineitem)"""
    return {
        "missing_value_rules": f"""
SELECT l_suppkey, {r(q.strict_sum(nulls))} AS strict_sum, {r(q.lenient_sum(nulls))} AS lenient_sum,
  {r(q.gated_sum(nulls, 'nullif(l_tax, 0.0)'))} AS gated_sum, {r(q.strict_mean(nulls))} AS strict_mean,
  {r(f'avg({nulls})')} AS lenient_mean, {r(q.strict_sd(nulls))} AS strict_sd,
  {r(f'stddev_samp({nulls})')} AS lenient_sd, {r(f'var_samp({nulls})')} AS lenient_var,
  count(*) AS all_rows, count({nulls}) AS present_rows,
  {q.distinct_with_missing(nulls)} AS distinct_values
FROM lineitem GROUP BY l_suppkey""",
        "pearson_by_group": q.query(
            pearson_source, final=_pearson_columns("c_nationkey", "moments")
        ),
        "kendall_by_group": _comma(
            """
priced AS (SELECT c_nationkey, o_totalprice AS x, c_acctbal AS y
           FROM orders JOIN customer ON o_custkey = c_custkey)""",
            _kendall("priced", "c_nationkey"),
        ),
        "kendall_ordinal": _comma(
            """
lines AS (SELECT l_returnflag, l_quantity AS x, l_discount AS y FROM lineitem)""",
            _kendall("lines", "l_returnflag"),
        ),
        "ols_by_group": q.query(
            responses,
            _terms("grp", ("l_quantity", "l_discount", "l_tax")),
            final=_term_columns("grp"),
        ),
        "anova_by_group": q.query(
            priced,
            _anova("inputs", "flag").format(x="l_quantity", g="l_linestatus"),
            final=_anova_columns("flag").replace("SELECT flag", "SELECT flag AS l_returnflag"),
        ),
        "trend_lines_by_group": f"""
SELECT l_shipmode_group AS series, count(*) AS n, {sig('regr_slope(y, x)')} AS slope,
  {sig('regr_intercept(y, x)')} AS intercept, min(x) AS x_from, max(x) AS x_to
FROM (SELECT l_returnflag AS l_shipmode_group, l_quantity AS x, l_extendedprice AS y FROM lineitem)
WHERE x BETWEEN 5 AND 45 AND y BETWEEN 1000 AND 60000 GROUP BY 1""",
        "event_richness": f"""
SELECT user_id, count(*) FILTER (ab <> 0) AS richness, {r(q.EVAR)} AS evar
FROM (SELECT user_id, event_type, count(*) AS ab FROM events GROUP BY 1, 2) GROUP BY user_id""",
    }


def oracles(permutations: int = 999) -> dict[str, str]:
    nb = "LEFT JOIN nb_info USING (nb)"
    out = {
        "clean_rows": q.query(
            q.OBS,
            final=f"""SELECT nb, block, house_id, family, genus, front_back, water_wghtd, water_man,
              num_plants_water, num_plants_water2, num_plants, native_plants, native_bin,
              num_flowers, color1, color2, {r('total_flower_area')} AS total_flower_area,
              flower_size, inf_type, symmetry, flowertype, photo_id, notes FROM obs""",
        ),
        "house_neighbourhoods": q.query(q.OBS, final="SELECT nb, house_id FROM link"),
        "house_totals": q.query(
            q.OBS,
            q.HOUSE_TOTALS,
            final=f"""SELECT nb, house_id, {_r('total_plants', 'total_plants_water',
              'total_flowers', 'total_area', 'avg_size', 'sd_size', 'var_size', 'total_natives',
              'sum_water_wghtd', 'water_wghtd_avg')} FROM house_totals""",
        ),
        "nb_summary": q.query(
            q.NB_INFO,
            q.OBS,
            q.HOUSE_TOTALS,
            q.NB_TOTALS,
            final=f"""SELECT nb, {_r('plants', 'sd_plants')}, n_plants, {_r('flowers', 'area',
              'm_size', 'm_sd_size', 'm_var_size', 'natives_abun', 'm_water')},
              {r('sd_plants / sqrt(n_plants)')} AS se_plants, {NB} FROM nb_totals {nb}""",
        ),
        "richness_evenness_house": q.query(
            q.OBS, q.GENUS, final=f"SELECT house_id, richness, {r('evar')} AS evar FROM genus_div"
        ),
        "richness_evenness": q.query(
            q.NB_INFO,
            q.OBS,
            q.GENUS,
            final=f"SELECT nb, {_r('flow_rich', 'flow_even')}, {NB} FROM nb_genus {nb}",
        ),
        "distinct_traits_house": q.query(q.OBS, q.TRAITS, final="SELECT * FROM house_traits"),
        "distinct_traits": q.query(
            q.NB_INFO,
            q.OBS,
            q.TRAITS,
            final=f"""SELECT nb, {_r('m_inflor', 'm_cols', 'm_sym', 'm_sd', 'm_genera', 'sd_cols',
              'sd_genera', 'sd_inflor')}, n_houses, {r('sd_cols / sqrt(n_houses)')} AS se_cols,
              {r('sd_genera / sqrt(n_houses)')} AS se_genera,
              {r('sd_inflor / sqrt(n_houses)')} AS se_inflor, {NB} FROM nb_traits {nb}""",
        ),
        "row_mean_cover": q.query(
            q.LAWN,
            final=f"""SELECT nb, block, house_id, species, f1, f2, b1, b2, n_fixer,
              {_r('ave_cov_f', 'ave_cov_b', 'ave_cov_all')}, native_merge, type FROM cover""",
        ),
        "item_importance": q.query(
            q.SURVEY, _importance(),
            final=f"SELECT variable, {_r('importance', 'sd')}, n, {r('se')} AS se FROM importance",
        ),
        "floral_taxon_long": q.query(
            *_community("floral"),
            final="""SELECT nb, block, taxon, abundance, nb_age, nb_inc, city, ann_precip, ave_elev,
              site FROM community""",
        ),
        "lawn_taxon_long": q.query(
            *_community("lawn"),
            final=f"""SELECT nb, block, taxon, {r('abundance')} AS abundance, nb_inc, nb_age, site
              FROM community""",
        ),
        "floral_taxon_wide": q.query(
            *_community("floral"),
            final=_wide("nb, block, nb_age, nb_inc, city, ann_precip, ave_elev", taxa()),
        ),
        "lawn_taxon_wide": q.query(
            *_community("lawn"), final=_wide("nb, block, nb_inc, nb_age", lawn_taxa())
        ),
        "plot_cover_long": q.query(
            q.LAWN,
            final=" UNION ALL ".join(
                f"SELECT nb, block, house_id, species, '{p}' AS plot, {p} AS cover FROM lawn"
                for p in ("f1", "f2", "b1", "b2")
            ),
        ),
        "color_area": _color_area(),
        "outer_zero_fill": q.query(
            q.OBS, q.LAWN, q.GENUS, q.LAWN_RICHNESS, q.LAYERS, final="SELECT * FROM both_layers"
        ),
        "layer_richness": q.query(
            q.NB_INFO, q.OBS, q.LAWN, q.GENUS, q.LAWN_RICHNESS, q.LAYERS,
            final=f"""SELECT nb, variable, {_r('num_species', 'sd')}, n, {r('sd / sqrt(n)')} AS se,
              {NB} FROM nb_layers {nb}""",
        ),
        "type_richness_by_income": q.query(
            q.NB_INFO, q.OBS, q.LAWN, q.TYPES,
            final=f"""SELECT {r('med_inc_short')} AS med_inc_short, type,
              {_r('type_mean', 'sd')}, n, {r('sd / sqrt(n)')} AS se FROM nb_types""",
        ),
        "front_back": q.query(
            q.NB_INFO, q.OBS, q.TRAITS, q.SIDES,
            final=f"""SELECT nb, front_back, {_r('plants', 'sd_plants')}, n_houses,
              {_r('flowers', 'area', 'm_cols', 'sd_cols', 'richness', 'sd_rich')},
              {r('sd_plants / sqrt(n_houses)')} AS se_plants,
              {r('sd_cols / sqrt(n_houses)')} AS se_cols,
              {r('sd_rich / sqrt(n_houses)')} AS se_rich,
              CASE WHEN richness = floor(richness) THEN CAST(CAST(richness AS BIGINT) AS VARCHAR)
                   ELSE CAST(richness AS VARCHAR) END AS richness_char, {NB}
              FROM nb_sides {nb}""",
        ),
        "right_zero_fill": q.query(q.OBS, q.NATIVES, final="SELECT * FROM house_natives"),
        "native_richness": q.query(
            q.NB_INFO, q.OBS, q.NATIVES,
            final=f"SELECT nb, {r('natf_rich')} AS natf_rich, {NB} FROM nb_natives {nb}",
        ),
        "lawn_richness_evenness_house": q.query(
            q.LAWN, q.LAWN_DIVERSITY,
            final=f"""SELECT house_id, CAST(richness AS DOUBLE) AS l_richness,
              {r('evar')} AS l_evenness FROM lawn_div""",
        ),
        "lawn_richness_evenness": q.query(
            q.NB_INFO, q.OBS, q.LAWN, q.LAWN_DIVERSITY,
            final=f"SELECT nb, {_r('l_richness', 'l_evenness')}, {NB} FROM nb_lawn_div {nb}",
        ),
        "native_cover": q.query(
            q.NB_INFO, q.LAWN, q.LAWN_NATIVES,
            final=f"SELECT nb, {_r('nat_rich_mer', 'nat_cover_mer')}, {NB} FROM nb_lawn_natives {nb}",
        ),
        "flower_labels": q.query(
            q.OBS,
            final="SELECT house_id, photo_id, allcol AS color_combo, taxon FROM obs",
        ),
        "water_need": q.query(
            q.OBS,
            final=f"""SELECT taxon, water_man, {q.strict_sum('num_plants')} AS plants,
              {q.strict_sum('num_plants')} * water_man AS water_weighted
              FROM obs GROUP BY taxon, water_man""",
        ),
        "lawn_per_house": q.query(
            q.LAWN,
            final=f"""SELECT house_id, {q.strict_sum('TRY_CAST(n_fixer AS DOUBLE)')} AS sum_nitrogen,
              {q.lenient_sum('TRY_CAST(native_merge AS DOUBLE)')} AS sum_native_sp,
              {r(q.lenient_sum('(TRY_CAST(native_merge AS DOUBLE) * ave_cov_all)'))}
                AS sum_native_cover
              FROM cover GROUP BY house_id""",
        ),
        "cover_by_type": q.query(
            q.LAWN,
            final=f"""SELECT type, {r(q.strict_mean('c'))} AS avg_cover FROM (
              SELECT type, {q.strict_sum('ave_cov_all')} AS c FROM cover
              GROUP BY nb, house_id, type) GROUP BY type""",
        ),
        "pearson_income": q.query(
            q.NB_INFO, q.SURVEY,
            _attitude("a8", "count(TRY_CAST(a8 AS DOUBLE))"), _attitude("a902", "count(*)"),
            """
pairs_in AS (SELECT 'a8' AS item, mean_a8 AS x, med_inc AS y FROM attitude_a8
             LEFT JOIN nb_info USING (nb)
  UNION ALL SELECT 'a902', mean_a902, med_inc FROM attitude_a902 LEFT JOIN nb_info USING (nb)),
moments AS (SELECT item, count(*) AS n, corr(x, y) AS r FROM pairs_in
            WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY item)""",
            final=_pearson_columns("item", "moments"),
        ),
        "pearson_colors_genera": q.query(
            q.OBS, q.TRAITS,
            "moments AS (SELECT count(*) AS n, corr(m_cols, m_genera) AS r FROM nb_traits)",
            final=_pearson_columns("'m_cols ~ m_genera' AS comparison", "moments"),
        ),
        "kendall": _comma(*DIRECT_TABLES, PREFERENCES, _kendall("preferences", "comparison")),
        "direct_house": q.query(
            *DIRECT_TABLES,
            final=f"""SELECT house_id, a6, a8, a902, {r('watercons')} AS watercons, color_num_f,
              rich_flowers, natives_rich_f, {r('water_wghtd_avg')} AS water_wghtd_avg,
              {r('native_cover_l')} AS native_cover_l FROM direct""",
        ),
        "ols_table": q.query(*REGRESSION_TABLES, final=_term_columns("response")),
        "ols_fits": q.query(*REGRESSION_TABLES, final=_fit_columns("response")),
        "partial_r2": q.query(
            *REGRESSION_TABLES,
            final="SELECT response, term, partial_r2 FROM ("
            + _term_columns("response")
            + ") WHERE term <> '(intercept)'",
        ),
        "anova_interaction": q.query(*INTERACTION_TABLES, final=_anova_columns("comparison")),
        "interaction_coefficients": q.query(
            *INTERACTION_TABLES, LINES, final=_interaction_terms()
        ),
        # figure tables
        "fig_importance_general": q.query(
            q.SURVEY, _importance(),
            final=f"""SELECT variable, {_r('importance', 'sd')}, n, {r('se')} AS se,
              {r('importance - se')} AS lower, {r('importance + se')} AS upper FROM importance
              WHERE variable IN ('Natives', 'Variety', 'Biodiversity')
                AND importance BETWEEN 0 AND 3 ORDER BY importance""",
        ),
        "fig_importance_traits": q.query(
            q.SURVEY, _importance(),
            final=f"""SELECT variable, {_r('importance', 'sd')}, n, {r('se')} AS se,
              {r('importance - se')} AS lower, {r('importance + se')} AS upper FROM importance
              WHERE variable NOT IN ('Natives', 'Variety', 'Biodiversity', 'A909', 'NB')
                AND importance BETWEEN 0 AND 3 ORDER BY importance""",
        ),
        "fig_attitude_biodiversity": q.query(
            q.NB_INFO, q.SURVEY, _attitude("a8", "count(TRY_CAST(a8 AS DOUBLE))"),
            final=f"""SELECT {r('med_inc_short')} AS x, {r('mean_a8')} AS y,
              {r('sd / sqrt(n)')} AS se, {r('mean_a8 - sd / sqrt(n)')} AS lower,
              {r('mean_a8 + sd / sqrt(n)')} AS upper FROM attitude_a8 {nb}
              WHERE mean_a8 BETWEEN 0 AND 3""",
        ),
        "fig_attitude_color": q.query(
            q.NB_INFO, q.SURVEY, _attitude("a902", "count(*)"),
            final=f"""SELECT {r('med_inc_short')} AS x, {r('mean_a902')} AS y,
              {r('sd / sqrt(n)')} AS se, {r('mean_a902 - sd / sqrt(n)')} AS lower,
              {r('mean_a902 + sd / sqrt(n)')} AS upper FROM attitude_a902 {nb}
              WHERE mean_a902 BETWEEN 0 AND 3""",
        ),
        "fig_colors_by_income": _comma(
            q.NB_INFO, q.OBS, q.TRAITS,
            f"placed AS (SELECT * FROM nb_traits {nb})",
            _trend("placed", "med_inc_short", "m_cols", "sd_cols / sqrt(n_houses)",
                   y_limits=(0, 40)),
        ),
        "fig_genera_by_colors": _comma(
            q.OBS, q.TRAITS,
            _trend("nb_traits", "m_cols", "m_genera", "sd_genera / sqrt(n_houses)",
                   x_limits=(0, 22), y_limits=(0, 60)),
        ),
        "fig_inflorescence_by_income": _comma(
            q.NB_INFO, q.OBS, q.TRAITS,
            f"placed AS (SELECT * FROM nb_traits {nb})",
            _trend("placed", "med_inc_short", "m_inflor", "sd_inflor / sqrt(n_houses)",
                   y_limits=(0, 6)),
        ),
        "fig_layers_by_income": _comma(
            q.NB_INFO, q.OBS, q.LAWN, q.GENUS, q.LAWN_RICHNESS, q.LAYERS,
            f"placed AS (SELECT * FROM nb_layers {nb})",
            _trend("placed", "med_inc_short", "num_species", "sd / sqrt(n)", y_limits=(0, 31),
                   group="variable"),
        ),
        "fig_types_by_income": _comma(
            q.NB_INFO, q.OBS, q.LAWN, q.TYPES,
            _trend("nb_types", "med_inc_short", "type_mean", "sd / sqrt(n)", y_limits=(0, 7.5),
                   group="type"),
        ),
        "fig_sides_richness": _comma(
            q.NB_INFO, q.OBS, q.TRAITS, q.SIDES,
            f"placed AS (SELECT * FROM nb_sides {nb})",
            _trend("placed", "med_inc_short", "richness", "sd_rich / sqrt(n_houses)",
                   y_limits=(0, 18), group="front_back"),
        ),
        "fig_sides_colors": _comma(
            q.NB_INFO, q.OBS, q.TRAITS, q.SIDES,
            f"placed AS (SELECT * FROM nb_sides {nb})",
            _trend("placed", "med_inc_short", "m_cols", "sd_cols / sqrt(n_houses)",
                   y_limits=(0, 14), group="front_back"),
        ),
        "fig_preference_scatter": q.query(
            *DIRECT_TABLES,
            final=f"""
SELECT 'a902 ~ color_num_f' AS comparison, a902 AS x, {r('color_num_f')} AS y FROM direct
WHERE a902 IS NOT NULL AND color_num_f BETWEEN 0 AND 21
UNION ALL SELECT 'a8 ~ rich_flowers', a8, {r('rich_flowers')} FROM direct
WHERE a8 IS NOT NULL AND rich_flowers BETWEEN 0 AND 35
UNION ALL SELECT 'a6 ~ natives_rich_f', a6, {r('natives_rich_f')} FROM direct
WHERE a6 IS NOT NULL AND natives_rich_f BETWEEN 0 AND 9
UNION ALL SELECT 'watercons ~ water_wghtd_avg', {r('watercons')}, {r('water_wghtd_avg')} FROM direct
WHERE watercons BETWEEN 0 AND 3 AND water_wghtd_avg BETWEEN 0 AND 3.5""",
        ),
    }
    out.update(_community_oracles("floral", permutations))
    out.update(_community_oracles("lawn", permutations))
    out.update(_large())
    return out
