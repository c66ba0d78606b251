"""SQL for each registered query, written for DuckDB on the same tables.

The statements follow the meaning of each table directly: attributes are joined
to single rows, pairs are formed by plain self-joins, missing-value rules are
CASE expressions.  None of the library's shortcuts is used here.
"""

from __future__ import annotations

from checks.rounding import sql_fixed as r
from checks.rounding import sql_significant as sig

COLORS = (
    "['Blue', 'Purple-Blue', 'Purple', 'Red-Purple', 'Red', 'Red-Orange', 'Orange', "
    "'Yellow-Orange', 'Yellow', 'Green-Yellow', 'White', 'brown', 'NoPhoto', 'brown']"
)

# ---------------------------------------------------------------- study tables

NB_INFO = """
income AS (SELECT c_nationkey AS k, round(avg(c_acctbal) * 10, 2) AS med_inc
           FROM customer GROUP BY 1),
built AS (SELECT c_nationkey AS k, round(avg(year(o_orderdate)), 4) AS yr_built
          FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
elevation AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 2) AS ave_elev
              FROM supplier GROUP BY 1),
nb_info AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS nb, med_inc, yr_built, ave_elev,
         CAST(n_regionkey * 2.5 + 10 AS DOUBLE) AS ann_precip,
         CASE n_nationkey % 3 WHEN 0 THEN 'old' WHEN 1 THEN 'middle' ELSE 'new' END AS nb_age,
         CASE WHEN n_regionkey <= 1 THEN 'low' WHEN n_regionkey <= 3 THEN 'mid'
              ELSE 'high' END AS nb_inc,
         r_name AS city, 'T' || CAST(n_regionkey AS VARCHAR) AS type,
         med_inc / 1000 AS med_inc_short
  FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN income i ON i.k = n_nationkey
  LEFT JOIN built b ON b.k = n_nationkey
  LEFT JOIN elevation e ON e.k = n_nationkey)"""

OBS = f"""
joined AS (
  SELECT *, l_quantity = 50 AS nothing, CAST(round(l_discount * 100) AS INT) AS disc,
         CAST(round(l_tax * 100) AS INT) AS tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
plant AS (
  SELECT CASE WHEN c_acctbal <= 9500 THEN CAST(c_nationkey AS VARCHAR) END AS nb,
    c_mktsegment AS block, CAST(c_custkey AS VARCHAR) AS house_id,
    CASE WHEN nothing THEN 'NoFlowers' ELSE p_brand END AS family,
    CASE WHEN nothing THEN 'NoFlowers' ELSE p_type END AS genus,
    CASE WHEN l_linestatus = 'F' THEN 'Front' ELSE 'Back' END AS front_back,
    CASE WHEN nothing THEN 0.0 WHEN c_nationkey >= 20 AND disc = 10 AND tax = 8 THEN NULL
         ELSE l_quantity END AS flower_plants,
    CASE WHEN c_nationkey = 19 AND disc = 10 AND tax = 8 THEN NULL
         ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) % 9 AS DOUBLE) END AS stems,
    CASE WHEN tax = 8 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS width,
    CASE WHEN tax = 7 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END AS length,
    CAST(disc AS DOUBLE) AS per_stem,
    CASE WHEN tax = 0 THEN NULL WHEN l_returnflag = 'N' THEN 'n/a'
         ELSE CAST(l_linenumber % 4 AS VARCHAR) END AS water_code,
    CASE WHEN disc = 0 THEN NULL ELSE CAST(l_linenumber % 2 AS DOUBLE) END AS native_bin,
    CASE WHEN nothing THEN 'NoFlowers' ELSE {COLORS}[l_suppkey % 14 + 1] END AS color1,
    CASE WHEN nothing OR l_linenumber <= 5 THEN '' WHEN tax = 3 THEN NULL
         ELSE {COLORS}[l_partkey % 11 + 1] END AS color2,
    CASE WHEN nothing THEN 'NoFlowers' WHEN tax = 6 AND disc = 6 THEN NULL
         ELSE o_orderpriority END AS inf_type,
    CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE l_returnflag END AS symmetry,
    CASE WHEN nothing THEN 'NoFlowers' ELSE o_orderstatus END AS flowertype,
    CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS photo_id,
    '' AS notes
  FROM joined),
obs AS (
  SELECT nb, block, house_id, family, genus, front_back,
    TRY_CAST(water_code AS DOUBLE)
      * CASE WHEN water_code IS NULL OR water_code = 'n/a' THEN NULL
             ELSE flower_plants END AS water_wghtd,
    TRY_CAST(water_code AS DOUBLE) AS water_man,
    CASE WHEN water_code IS NULL THEN NULL WHEN water_code = 'n/a' THEN 'n/a'
         ELSE CAST(CAST(flower_plants AS BIGINT) AS VARCHAR) END AS num_plants_water,
    CASE WHEN water_code IS NULL OR water_code = 'n/a' THEN NULL
         ELSE flower_plants END AS num_plants_water2,
    flower_plants AS num_plants, native_bin * flower_plants AS native_plants, native_bin,
    stems * per_stem AS num_flowers, color1, color2,
    width * length * (stems * per_stem) / 10000 AS total_flower_area,
    width * length AS flower_size, inf_type, symmetry, flowertype, photo_id, notes,
    family || ' ' || genus AS taxon,
    color1 || ' ' || coalesce(color2, 'NA') AS allcol
  FROM plant WHERE nb <> 'NA' AND house_id <> '387_11_4'),
link AS (SELECT DISTINCT nb, house_id FROM obs)"""

SPECIES = "o_orderstatus || '-' || o_orderpriority || '-' || CAST(year(o_orderdate) AS VARCHAR)"

LAWN = f"""
native_lawn AS (
  SELECT DISTINCT {SPECIES} AS species,
    CASE WHEN year(o_orderdate) = 1995 THEN NULL WHEN year(o_orderdate) % 3 = 0 THEN 'n/a'
         ELSE CAST(year(o_orderdate) % 2 AS VARCHAR) END AS native_merge,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Weed' WHEN '2-HIGH' THEN 'Seedling'
         ELSE 'Lawn' END AS type
  FROM orders),
lawn_rows AS (
  SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS price,
         o_orderstatus = 'P' AND o_orderpriority = '5-LOW' AS skipped
  FROM orders JOIN customer ON o_custkey = c_custkey),
lawn AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS nb, c_mktsegment AS block,
    CAST(c_custkey AS VARCHAR) AS house_id,
    CASE WHEN c_acctbal < 0 THEN 'NO LAWN' WHEN skipped THEN 'Not collected'
         ELSE {SPECIES} END AS species,
    CASE WHEN NOT skipped THEN CAST(price % 50 AS DOUBLE) END AS f1,
    CASE WHEN NOT skipped AND o_orderpriority <> '1-URGENT'
         THEN CAST(price % 7 AS DOUBLE) END AS f2,
    CASE WHEN NOT skipped AND NOT (c_nationkey >= 22 AND o_orderstatus = 'F')
         THEN CAST(price % 13 AS DOUBLE) END AS b1,
    CASE WHEN NOT skipped THEN CAST(price % 29 AS DOUBLE) END AS b2,
    CASE WHEN c_nationkey = 3 AND o_orderpriority = '2-HIGH' THEN 'n/a'
         ELSE CAST(day(o_orderdate) % 2 AS VARCHAR) END AS n_fixer
  FROM lawn_rows WHERE CAST(c_custkey AS VARCHAR) NOT IN ('387_11_4', '651_1_4')),
cover AS (
  SELECT l.*, (f1 + f2) / 2 AS ave_cov_f, (b1 + b2) / 2 AS ave_cov_b,
    CASE WHEN (f1 + f2) IS NULL THEN (b1 + b2) / 2 WHEN (b1 + b2) IS NULL THEN (f1 + f2) / 2
         ELSE ((f1 + f2) / 2 + (b1 + b2) / 2) / 2 END AS ave_cov_all,
    native_merge, type
  FROM lawn l LEFT JOIN native_lawn n USING (species)
  WHERE species <> 'NO LAWN' AND species <> 'Not collected')"""


def _survey() -> str:
    items = ["a6", "a7", "a8", "a901", "a902", "a903", "a904", "a905", "a906", "a907"]
    answer = {item: f"CAST((cents // {4 ** i}) % 4 AS VARCHAR)" for i, item in enumerate(items)}
    answer["a8"] = f"CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'no answer' ELSE {answer['a8']} END"
    answer["a902"] = f"CASE WHEN c_acctbal < 500 THEN NULL ELSE {answer['a902']} END"
    answer["a908"] = "CAST(c_custkey % 4 AS VARCHAR)"
    answer["a909"] = "CAST((c_custkey // 4) % 4 AS VARCHAR)"
    answer["a910"] = "CAST((c_custkey // 16) % 4 AS VARCHAR)"
    columns = ", ".join(f"{sql} AS {name}" for name, sql in answer.items())
    return f"""
cents AS (SELECT *, abs(CAST(round(c_acctbal * 100) AS BIGINT)) AS cents FROM customer),
survey AS (SELECT 'P' || CAST(c_custkey AS VARCHAR) AS parcel_id,
             CAST(c_custkey AS VARCHAR) AS house_id, CAST(c_nationkey AS VARCHAR) AS nb, {columns}
           FROM cents)"""


SURVEY = _survey()
NB_COLUMNS = (
    "med_inc, yr_built, ave_elev, ann_precip, nb_age, nb_inc, city, type, "
    f"{r('med_inc_short')} AS med_inc_short"
)


# ---------------------------------------------------------------- rules as SQL


def strict(aggregate: str, x: str) -> str:
    return f"CASE WHEN count({x}) = count(*) THEN {aggregate}({x}) END"


def strict_sum(x: str) -> str:
    return strict("sum", x)


def strict_mean(x: str) -> str:
    return strict("avg", x)


def strict_sd(x: str) -> str:
    return strict("stddev_samp", x)


def lenient_sum(x: str) -> str:
    return f"coalesce(sum({x}), 0.0)"


def gated_sum(x: str, gate: str) -> str:
    return f"CASE WHEN count({gate}) > 0 THEN {lenient_sum(x)} ELSE {strict_sum(x)} END"


def traits(x: str) -> str:
    return (
        f"count(DISTINCT CASE WHEN {x} <> '0' THEN {x} END)"
        f" + max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END)"
    )


def distinct_with_missing(x: str) -> str:
    return f"count(DISTINCT {x}) + max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END)"


def f_tail(f: str, df1: str, df2: str, steps: int = 4000) -> str:
    """Upper tail of F by Simpson's rule on the sine form of the beta integral.

    The integrand falls off within a few 1/sqrt(df2) below its upper limit, so 40
    of those are integrated.
    """
    top = f"atan(sqrt({df2} / ({df1} * {f})))"
    width = f"least({top}, 40 / sqrt({df2}))"
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END"
    angle = f"({top} - {width} * k / {steps})"
    integral = (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda k: CAST({weight} AS DOUBLE)"
        f" * pow(sin{angle}, {df2} - 1) * pow(cos{angle}, {df1} - 1))) * {width} / (3 * {steps})"
    )
    scale = f"2 * exp(lgamma(({df1} + {df2}) / 2.0) - lgamma({df1} / 2.0) - lgamma({df2} / 2.0))"
    return f"({scale} * {integral})"


def t_tail(t: str, df: str) -> str:
    return f"CASE WHEN {t} = 0 THEN 1.0 ELSE {f_tail(f'({t} * {t})', '1.0', df)} END"


def normal_tail(z: str, steps: int = 4000) -> str:
    """Two-sided normal tail by Simpson's rule between 0 and |z|."""
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END"
    integral = (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda k: CAST({weight} AS DOUBLE)"
        f" * exp(-0.5 * pow(abs({z}) * k / {steps}, 2)))) * abs({z}) / (3 * {steps})"
    )
    return f"(1 - 2 * {integral} / sqrt(2 * pi()))"


def query(*tables: str, final: str) -> str:
    return f"WITH {','.join(tables)}\n{final}"


# ---------------------------------------------------------------- table queries

HOUSE_TOTALS = f"""
house_sums AS (
  SELECT nb, house_id, {strict_sum('num_plants')} AS total_plants,
    {gated_sum('num_plants_water2', 'water_wghtd')} AS total_plants_water,
    {strict_sum('num_flowers')} AS total_flowers,
    {lenient_sum('total_flower_area')} AS total_area,
    avg(flower_size) AS avg_size, stddev_samp(flower_size) AS sd_size,
    var_samp(flower_size) AS var_size, {lenient_sum('native_plants')} AS total_natives,
    {gated_sum('water_wghtd', 'water_wghtd')} AS sum_water_wghtd
  FROM obs GROUP BY nb, house_id),
house_totals AS (
  SELECT *, sum_water_wghtd / nullif(total_plants_water, 0) AS water_wghtd_avg FROM house_sums)"""

NB_TOTALS = f"""
nb_totals AS (
  SELECT nb, {strict_mean('total_plants')} AS plants, {strict_sd('total_plants')} AS sd_plants,
    count(*) AS n_plants, {strict_mean('total_flowers')} AS flowers,
    {strict_mean('total_area')} AS area, {strict_mean('avg_size')} AS m_size,
    avg(sd_size) AS m_sd_size, avg(var_size) AS m_var_size, avg(total_natives) AS natives_abun,
    avg(water_wghtd_avg) AS m_water
  FROM house_totals GROUP BY nb)"""

EVAR = """CASE WHEN count(*) FILTER (ab <> 0) > 1
      THEN 1 - 2 / pi() * atan(var_pop(CASE WHEN ab > 0 THEN ln(ab) END)) END"""

GENUS = f"""
genus_sums AS (SELECT house_id, taxon, {strict_sum('num_plants')} AS ab
               FROM obs GROUP BY house_id, taxon),
genus_div AS (SELECT house_id, count(*) FILTER (ab <> 0) AS richness, {EVAR} AS evar
              FROM genus_sums WHERE ab IS NOT NULL GROUP BY house_id),
nb_genus AS (SELECT nb, {strict_mean('richness')} AS flow_rich, avg(evar) AS flow_even
             FROM genus_div LEFT JOIN link USING (house_id) GROUP BY nb)"""

TRAITS = f"""
coded AS (
  SELECT *, CASE WHEN inf_type = 'NoFlowers' THEN '0' ELSE inf_type END AS inflor,
    CASE WHEN allcol = 'NoFlowers ' THEN '0' ELSE allcol END AS colors,
    CASE WHEN taxon = 'NoFlowers NoFlowers' THEN '0' ELSE taxon END AS genera,
    CASE WHEN symmetry IN ('NoFlowers', 'Unknown') THEN '0' ELSE symmetry END AS symm,
    CASE WHEN flowertype IN ('NoFlowers', 'Unknown') THEN '0' ELSE flowertype END AS sing_doub
  FROM obs),
house_traits AS (
  SELECT nb, block, house_id, {traits('inflor')} AS inflo_num, {traits('colors')} AS color_num,
    {traits('symm')} AS sym_num, {traits('sing_doub')} AS sd_num, {traits('genera')} AS genera_num
  FROM coded GROUP BY nb, block, house_id),
nb_traits AS (
  SELECT nb, avg(inflo_num) AS m_inflor, avg(color_num) AS m_cols, avg(sym_num) AS m_sym,
    avg(sd_num) AS m_sd, avg(genera_num) AS m_genera, stddev_samp(color_num) AS sd_cols,
    stddev_samp(genera_num) AS sd_genera, stddev_samp(inflo_num) AS sd_inflor,
    count(*) AS n_houses
  FROM house_traits GROUP BY nb)"""

SIDES = f"""
sides AS (
  SELECT nb, block, house_id, front_back, {strict_sum('num_plants')} AS total_plants,
    {strict_sum('num_flowers')} AS total_flowers,
    {lenient_sum('total_flower_area')} AS total_area, {traits('colors')} AS color_num,
    {traits('genera')} AS total_genera
  FROM coded GROUP BY nb, block, house_id, front_back),
nb_sides AS (
  SELECT nb, front_back, {strict_mean('total_plants')} AS plants,
    {strict_sd('total_plants')} AS sd_plants, count(*) AS n_houses,
    {strict_mean('total_flowers')} AS flowers, {strict_mean('total_area')} AS area,
    avg(color_num) AS m_cols, stddev_samp(color_num) AS sd_cols,
    avg(total_genera) AS richness, stddev_samp(total_genera) AS sd_rich
  FROM sides GROUP BY nb, front_back)"""

LAWN_RICHNESS = f"""
lawn_richness AS (SELECT nb, house_id, {distinct_with_missing('species')} AS lawn_richness
                  FROM cover GROUP BY nb, house_id)"""

LAYERS = """
flower_side AS (SELECT link.nb, house_id, richness FROM genus_div LEFT JOIN link USING (house_id)),
both_layers AS (
  SELECT coalesce(l.nb, f.nb, '0') AS nb, coalesce(l.house_id, f.house_id) AS house_id,
         coalesce(lawn_richness, 0) AS lawn_richness, coalesce(richness, 0) AS richness
  FROM lawn_richness l FULL JOIN flower_side f
    ON l.nb IS NOT DISTINCT FROM f.nb AND l.house_id = f.house_id),
long_layers AS (
  SELECT nb, 'Lawn species' AS variable, lawn_richness AS value FROM both_layers
  UNION ALL SELECT nb, 'Flowering plant genera', richness FROM both_layers),
nb_layers AS (
  SELECT nb, variable, avg(value) AS num_species, stddev_samp(value) AS sd, count(*) AS n
  FROM long_layers GROUP BY nb, variable)"""

TYPES = f"""
house_types AS (
  SELECT house_id, CASE type WHEN 'Lawn' THEN 'Turfgrasses' WHEN 'Weed' THEN 'Weeds'
                   WHEN 'Seedling' THEN 'Weeds' ELSE type END AS type,
         species FROM cover),
type_sums AS (SELECT house_id, type, {distinct_with_missing('species')} AS type_sum
              FROM house_types GROUP BY house_id, type),
nb_types AS (
  SELECT med_inc_short, s.type, avg(type_sum) AS type_mean, stddev_samp(type_sum) AS sd,
         count(*) AS n
  FROM type_sums s LEFT JOIN link USING (house_id) LEFT JOIN nb_info i ON i.nb = link.nb
  GROUP BY med_inc_short, s.type)"""

NATIVES = f"""
house_natives AS (
  SELECT link.nb, link.house_id, coalesce(k.natives_rich, 0) AS natives_rich
  FROM (SELECT nb, house_id, {distinct_with_missing('taxon')} AS natives_rich
        FROM obs WHERE native_bin <> 0 GROUP BY nb, house_id) k
  RIGHT JOIN link ON k.nb = link.nb AND k.house_id = link.house_id),
nb_natives AS (SELECT nb, avg(natives_rich) AS natf_rich FROM house_natives GROUP BY nb)"""

LAWN_DIVERSITY = f"""
lawn_div AS (
  SELECT house_id, count(*) FILTER (ab <> 0) AS richness, {EVAR} AS evar
  FROM (SELECT house_id, ave_cov_all AS ab FROM cover) WHERE ab IS NOT NULL GROUP BY house_id),
nb_lawn_div AS (
  SELECT nb, avg(richness) AS l_richness, avg(evar) AS l_evenness
  FROM lawn_div LEFT JOIN link USING (house_id) GROUP BY nb)"""

LAWN_NATIVES = f"""
lawn_natives AS (
  SELECT nb, house_id, {strict_sum('(CAST(native_merge AS DOUBLE) * ave_cov_all)')} AS native_cover,
         sum(CAST(native_merge AS DOUBLE)) AS native_rich
  FROM cover WHERE native_merge <> 'n/a' GROUP BY nb, house_id),
nb_lawn_natives AS (
  SELECT nb, avg(native_rich) AS nat_rich_mer, {strict_mean('native_cover')} AS nat_cover_mer
  FROM lawn_natives GROUP BY nb)"""

FLORAL_COMMUNITY = f"""
floral_site AS (
  SELECT nb, block, nb_age, nb_inc, city, ann_precip, ave_elev,
         family || '_' || genus AS taxon, {strict_sum('num_plants')} AS abundance
  FROM obs LEFT JOIN nb_info USING (nb) GROUP BY ALL),
community AS (
  SELECT *, nb || '_' || block AS site FROM floral_site WHERE abundance <> 0)"""

LAWN_COMMUNITY = """
plots AS (
  SELECT nb, block, species, f1 AS cover FROM lawn UNION ALL SELECT nb, block, species, f2 FROM lawn
  UNION ALL SELECT nb, block, species, b1 FROM lawn
  UNION ALL SELECT nb, block, species, b2 FROM lawn),
community AS (
  SELECT nb, block, species AS taxon, avg(cover) AS abundance, nb_inc, nb_age,
         nb || '_' || block AS site
  FROM plots LEFT JOIN nb_info USING (nb)
  WHERE species <> 'NO LAWN' GROUP BY ALL)"""

PAIRS = """
cells AS (SELECT site, taxon, abundance FROM community WHERE abundance > 0),
site_totals AS (SELECT site, sum(abundance) AS total FROM cells GROUP BY site),
common AS (
  SELECT a.site AS site_i, b.site AS site_j, sum(least(a.abundance, b.abundance)) AS shared
  FROM cells a JOIN cells b ON a.taxon = b.taxon AND a.site < b.site GROUP BY 1, 2),
pairs AS (
  SELECT i.site AS site_i, j.site AS site_j,
         1 - 2 * coalesce(shared, 0) / (i.total + j.total) AS d
  FROM site_totals i JOIN site_totals j ON i.site < j.site
  LEFT JOIN common c ON c.site_i = i.site AND c.site_j = j.site)"""


def labels(factors: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS factor, site, coalesce(CAST({f} AS VARCHAR), 'NA') AS label FROM sites"
        for f in factors
    )
    return f"""
sites AS (SELECT DISTINCT site, nb, nb_age, nb_inc FROM community WHERE abundance > 0),
labels AS ({parts}),
sizes AS (SELECT factor, label, count(*) AS size FROM labels GROUP BY 1, 2),
design AS (SELECT factor, sum(size) AS n, count(*) AS k FROM sizes GROUP BY 1)"""


def shuffles(permutations: int) -> str:
    return f"""
ranked AS (
  SELECT p, site, row_number() OVER (PARTITION BY p
           ORDER BY md5(concat_ws('|', CAST(p AS VARCHAR), site)), site) AS r
  FROM (SELECT DISTINCT site FROM labels), range(0, {permutations + 1}) t(p)),
moved AS (SELECT a.p, a.site, b.site AS source FROM ranked a JOIN ranked b ON b.p = 0 AND a.r = b.r
          WHERE a.p > 0)"""


PERMANOVA = """
within_obs AS (
  SELECT factor, sum(d2 / size) AS ss_within FROM (
    SELECT a.factor, a.label, sum(d * d) AS d2 FROM pairs
    JOIN labels a ON a.site = site_i
    JOIN labels b ON b.site = site_j AND b.factor = a.factor AND b.label = a.label
    GROUP BY 1, 2) JOIN sizes USING (factor, label) GROUP BY factor),
fit AS (
  SELECT factor, n, k, ss_within, total / n AS ss_total,
         ((total / n - ss_within) / (k - 1)) / (ss_within / (n - k)) AS pseudo_f
  FROM within_obs JOIN design USING (factor), (SELECT sum(d * d) AS total FROM pairs))"""

PERMANOVA_COLUMNS = f"""factor, CAST(n AS BIGINT) AS n, CAST(k - 1 AS BIGINT) AS df_between,
  CAST(n - k AS BIGINT) AS df_within, {r('ss_total - ss_within')} AS ss_between,
  {r('ss_within')} AS ss_within, {r('ss_total')} AS ss_total, {r('pseudo_f')} AS pseudo_f,
  {r('1 - ss_within / ss_total')} AS r2"""


def permanova_permuted(permutations: int) -> str:
    return f"""
moved_labels AS (SELECT m.p, m.site, l.factor, l.label FROM moved m JOIN labels l
                 ON l.site = m.source),
within_perm AS (
  SELECT factor, p, sum(d2 / size) AS ss_perm FROM (
    SELECT a.factor, a.p, a.label, sum(d * d) AS d2 FROM pairs
    JOIN moved_labels a ON a.site = site_i
    JOIN moved_labels b ON b.site = site_j AND b.p = a.p AND b.factor = a.factor
      AND b.label = a.label
    GROUP BY 1, 2, 3) JOIN sizes USING (factor, label) GROUP BY 1, 2),
exceed AS (
  SELECT factor, count(*) FILTER (
    ((ss_total - ss_perm) / (k - 1)) / (ss_perm / (n - k)) >= pseudo_f - sqrt(2.220446049250313e-16)
  ) AS exceed
  FROM within_perm JOIN fit USING (factor) GROUP BY factor)"""


DISPERSION = """
inside AS (
  SELECT a.factor, a.label, site_i, site_j, d * d AS d2 FROM pairs
  JOIN labels a ON a.site = site_i
  JOIN labels b ON b.site = site_j AND b.factor = a.factor AND b.label = a.label),
reach AS (
  SELECT factor, label, site, sum(d2) AS to_members FROM (
    SELECT factor, label, site_i AS site, d2 FROM inside
    UNION ALL SELECT factor, label, site_j, d2 FROM inside) GROUP BY 1, 2, 3),
group_sum AS (SELECT factor, label, sum(d2) AS total FROM inside GROUP BY 1, 2),
z AS (
  SELECT factor, label, l.site,
    sqrt(abs(coalesce(to_members, 0) / size - coalesce(total, 0) / (size * size))) AS z
  FROM labels l JOIN sizes USING (factor, label)
  LEFT JOIN reach USING (factor, label, site) LEFT JOIN group_sum USING (factor, label))"""


def dispersion_permuted() -> str:
    return """
resid AS (SELECT *, z - avg(z) OVER (PARTITION BY factor, label) AS e FROM z),
overall AS (SELECT factor, count(*) AS n, count(DISTINCT label) AS k, avg(z) AS grand,
              sum(e * e) AS ss_within, avg(e) AS mean_e FROM resid GROUP BY factor),
between_groups AS (
  SELECT factor, sum(cnt * (mz - grand) * (mz - grand)) AS ss_between
  FROM (SELECT factor, label, count(*) AS cnt, avg(z) AS mz FROM z GROUP BY 1, 2)
  JOIN overall USING (factor) GROUP BY factor),
fit AS (SELECT *, (ss_between / (k - 1)) / (ss_within / (n - k)) AS f
        FROM overall JOIN between_groups USING (factor)),
placed AS (
  SELECT s.factor, m.p, t.label, sum(s.e) AS s1, count(*) AS cnt
  FROM moved m JOIN resid s ON s.site = m.source
  JOIN resid t ON t.site = m.site AND t.factor = s.factor GROUP BY 1, 2, 3),
explained AS (SELECT factor, p, sum(s1 * s1 / cnt) AS ss FROM placed GROUP BY 1, 2),
exceed AS (
  SELECT factor, count(*) FILTER (
    ((ss - n * mean_e * mean_e) / (k - 1)) / ((ss_within - ss) / (n - k))
      >= f - sqrt(2.220446049250313e-16)) AS exceed
  FROM explained JOIN fit USING (factor) GROUP BY factor)"""
