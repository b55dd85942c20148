"""DuckDB SQL of the registered queries, over the plain tables.

``cube`` and ``pred`` are the same fixtures that ``gridloom.sources.fixtures`` builds.
"""

from __future__ import annotations

CUBE = """
WITH cells AS (
  SELECT l_suppkey AS pixel_id, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS time_idx,
         avg(l_extendedprice) AS target, avg(l_quantity) AS qty, avg(l_discount) AS disc, avg(l_tax) AS tax
  FROM lineitem GROUP BY 1, 2
), times AS (
  SELECT CAST(unnest(range((SELECT min(time_idx) FROM cells), (SELECT max(time_idx) + 1 FROM cells))) AS INT) AS time_idx
), pix AS (
  SELECT s_suppkey AS pixel_id, CAST(s_suppkey // 10 AS INT) AS lat_idx, CAST(s_suppkey % 10 AS INT) AS lon_idx, n_regionkey AS code, r_name AS label, s_acctbal > 0 AS keep
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), cube AS (
  SELECT p.*, t.time_idx, make_date(1995 + t.time_idx // 12, t.time_idx % 12 + 1, 1) AS time, CAST(t.time_idx % 12 + 1 AS INT) AS month,
         CAST(1995 + t.time_idx // 12 AS INT) AS year, c.target, c.qty, c.disc, c.tax
  FROM pix p CROSS JOIN times t LEFT JOIN cells c ON c.pixel_id = p.pixel_id AND c.time_idx = t.time_idx
)"""

PRED = """
WITH pix AS (
  SELECT s_suppkey AS pixel_id, n_regionkey AS code, r_name AS label, s_acctbal > 0 AS keep
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), pred AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS pixel_id, CAST(l_suppkey // 10 AS INT) AS lat_idx, CAST(l_suppkey % 10 AS INT) AS lon_idx,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS time, l_extendedprice AS y, l_quantity * p_retailprice AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

VARIABLES = ["target", "qty", "disc", "tax"]
PREDICTORS = ["qty", "disc", "tax"]
CORE = "count(*) AS n, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae"
R2 = "1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0)"


def corr(x: str, y: str, least: int = 2) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"round(CASE WHEN count({a}) >= {least} AND stddev_pop({a}) * stddev_pop({b}) > 0 THEN covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) END, 6)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def cube(select: str, more: str = "") -> str:
    return f"{CUBE}{', ' + more if more else ''}\n{select}"


def pred(select: str, more: str = "") -> str:
    return f"{PRED}{', ' + more if more else ''}\n{select}"


def corr_by(keys: str, source: str = "cube", names: list[str] = PREDICTORS, suffix: str = "", extra: str = "") -> str:
    head = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return union([f"SELECT {head}'{p}' AS predictor, {i} AS place{extra}, {corr('target', p + suffix)} AS r FROM {source}{group}" for i, p in enumerate(names)])


LAGS = ", ".join(f"max({p}) OVER (PARTITION BY pixel_id ORDER BY time_idx RANGE BETWEEN {k} PRECEDING AND {k} PRECEDING) AS {p}_{k}" for p in PREDICTORS for k in (0, 1, 2, 3))
LAGGED = f"lagged AS (SELECT *, {LAGS} FROM cube)"


def lag_corr(keys: str) -> str:
    head, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return union([f"SELECT {head}'{p}' AS predictor, CAST({k} AS INT) AS lag, {corr('target', f'{p}_{k}')} AS r FROM lagged{group}" for p in PREDICTORS for k in (0, 1, 2, 3)])


def strongest(keys: str) -> str:
    return f"""SELECT {keys}, CASE WHEN r IS NULL THEN NULL ELSE predictor END AS predictor, r, CAST(CASE WHEN r IS NULL THEN 0 ELSE place + 1 END AS INT) AS dominant_code
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY abs(r) DESC NULLS LAST, place) AS n FROM found) WHERE n = 1"""


def quantiles(v: str) -> str:
    names = (1, 5, 25, 50, 75, 95, 99)
    return ", ".join(f"round(quantile_cont({v}, {p / 100}), 6) AS p{p:02d}" for p in names)


def ranked(ids: str, seed: int, source: str, by: str = "") -> str:
    parts = " || ':' || ".join([f"'{seed}'", *(f"CAST({i} AS VARCHAR)" for i in ids.split(", "))])
    return f"SELECT *, row_number() OVER ({'PARTITION BY ' + by if by else ''} ORDER BY md5({parts}), {ids}) AS rank, count(*) OVER ({'PARTITION BY ' + by if by else ''}) AS total FROM {source}"


#: train half of what is valid, and of those a quarter for the test; halves to even
SIZES = """SELECT *, greatest(1, round_even(total * 0.5::DOUBLE, 0)) AS chosen FROM ranks"""
SPLIT = "CASE WHEN rank <= CASE WHEN chosen <= 1 THEN 0 ELSE least(greatest(1, round_even(chosen * 0.25::DOUBLE, 0)), chosen - 1) END THEN 'test' WHEN rank <= chosen THEN 'train' END AS split"
OK = "target IS NOT NULL AND qty IS NOT NULL AND disc IS NOT NULL AND tax IS NOT NULL"
OBS = f"valid AS (SELECT pixel_id, time_idx FROM cube WHERE {OK}), ranks AS ({ranked('pixel_id, time_idx', 42, 'valid')}), sizes AS ({SIZES}), split AS (SELECT pixel_id, time_idx, {SPLIT} FROM sizes)"
SPATIAL = f"valid AS (SELECT pixel_id FROM cube GROUP BY pixel_id HAVING avg(CASE WHEN {OK} THEN 1 ELSE 0 END) >= 0.9), ranks AS ({ranked('pixel_id', 42, 'valid')}), sizes AS ({SIZES}), split AS (SELECT pixel_id, {SPLIT} FROM sizes)"
YEARS = "steps AS (SELECT DISTINCT time FROM cube), years AS (SELECT time, (date_diff('day', (SELECT min(time) FROM steps), time) - (SELECT avg(date_diff('day', (SELECT min(time) FROM steps), time)) FROM steps)) / 365.2425::DOUBLE AS time_years FROM steps)"
SLOPES = "slopes AS (SELECT p.pixel_id, coalesce(m.slope, 0) AS slope FROM pix p LEFT JOIN (SELECT a.pixel_id, median((b.target - a.target) / (date_diff('day', DATE '1970-01-01', b.time) / 365.2425::DOUBLE - date_diff('day', DATE '1970-01-01', a.time) / 365.2425::DOUBLE)) AS slope FROM cube a JOIN cube b ON a.pixel_id = b.pixel_id AND a.time_idx < b.time_idx WHERE a.target IS NOT NULL AND b.target IS NOT NULL GROUP BY a.pixel_id) m ON m.pixel_id = p.pixel_id)"
PIXEL = f"pixel AS (SELECT pixel_id, count(*) AS n, sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae, CASE WHEN count(*) >= 2 AND var_pop(y) > 1e-8 THEN {R2} END AS r2, var_pop(y) AS y_variance, min(lat_idx) AS lat_idx, min(lon_idx) AS lon_idx FROM pred GROUP BY pixel_id)"


def edges(value: str, n: int, source: str) -> str:
    return f"e AS (SELECT list_sort(list_distinct(quantile_cont({value}, [{', '.join(f'{i / n}::DOUBLE' for i in range(n + 1))}]))) AS e FROM {source})"


def bin_of(value: str) -> str:
    return f"CAST(len(list_filter(e.e[2:len(e.e) - 1], lambda x: {value} > x)) AS INT)"


def hexagons(columns: int) -> str:
    rows = int(columns / 3**0.5)
    return f"""b AS (SELECT min(y) AS x0, max(y) AS x1, min(p) AS y0, max(p) AS y1 FROM pred),
    s AS (SELECT (y - x0) / ((x1 - x0) / {columns}) AS a, (p - y0) / ((y1 - y0) / {rows}) AS b FROM pred, b),
    c AS (SELECT a, b, floor(a + 0.5) AS i, floor(b + 0.5) AS j, least(floor(a), {columns - 1}) AS k, least(floor(b), {rows - 1}) AS l FROM s),
    h AS (SELECT *, (a - i) * (a - i) + 3.0::DOUBLE * (b - j) * (b - j) > (a - k - 0.5) * (a - k - 0.5) + 3.0::DOUBLE * (b - l - 0.5) * (b - l - 0.5) AS odd FROM c),
    hex AS (SELECT CAST(CASE WHEN odd THEN 2 * k + 1 ELSE 2 * i END AS INT) AS hx, CAST(CASE WHEN odd THEN 2 * l + 1 ELSE 2 * j END AS INT) AS hy, count(*) AS n FROM h GROUP BY 1, 2)"""


YEARLY = "yearly AS (SELECT pixel_id, year, make_date(year, 1, 1) AS time, avg(target) AS lai, coalesce(sum(qty), 0) AS tp, avg(disc) AS sm FROM cube WHERE year <= 2000 GROUP BY pixel_id, year)"
_SHORT = "target IS NOT NULL AND qty IS NOT NULL"
_WHOLE = f"{_SHORT} AND disc IS NOT NULL"
_REDONE = "prepared LAI,prepared TP,prepared SM,cube,split"
SCENARIOS = [
    ("first", _REDONE, f"keep AND {_WHOLE}"), ("same", "", f"keep AND {_WHOLE}"), ("mask", _REDONE, f"code IN (0, 1, 2) AND {_WHOLE}"), ("pixels", "cube,split", f"keep AND {_WHOLE}"),
    ("years", _REDONE, f"keep AND year BETWEEN 1996 AND 1998 AND {_WHOLE}"), ("predictors", "cube,split", f"keep AND {_SHORT}"), ("source", "prepared SM,cube,split", f"keep AND time_idx % 2 = 0 AND {_WHOLE}"),
]

SQL: dict[str, str] = {
    "scan_time_roi": cube("SELECT pixel_id, time_idx, round(target, 6) AS target FROM cube WHERE year BETWEEN 1996 AND 1998 AND lat_idx BETWEEN 0 AND 4 AND lon_idx BETWEEN 2 AND 7"),
    "lag_name_parse": "SELECT DISTINCT n_name AS name, CASE WHEN regexp_matches(upper(trim(n_name || '_LAG_' || n_regionkey)), '^[A-Z0-9_]+_LAG_[0-9]+$') THEN upper(n_name) ELSE upper(n_name || '_LAG_' || n_regionkey) END AS base, CAST(CASE WHEN regexp_matches(upper(n_name || '_LAG_' || n_regionkey), '^[A-Z0-9_]+_LAG_[0-9]+$') THEN n_regionkey ELSE 0 END AS INT) AS lag FROM nation",
    "dense_spine": cube("SELECT pixel_id, time_idx, time, round(target, 6) AS target FROM cube"),
    "cube_long": cube(union([f"SELECT pixel_id, time_idx, '{v}' AS variable, round({v}, 6) AS value FROM cube" for v in VARIABLES])),
    "grid_metadata": cube("SELECT min(lat_idx) AS lat_min, max(lat_idx) AS lat_max, count(DISTINCT lat_idx) AS n_lat, min(lon_idx) AS lon_min, max(lon_idx) AS lon_max, count(DISTINCT lon_idx) AS n_lon, count(DISTINCT time_idx) AS n_time, min(time) AS time_min, max(time) AS time_max, round((max(lat_idx) - min(lat_idx)) / nullif(count(DISTINCT lat_idx) - 1, 0), 6) AS lat_step, round((max(lon_idx) - min(lon_idx)) / nullif(count(DISTINCT lon_idx) - 1, 0), 6) AS lon_step FROM cube"),
    "time_resolution": cube("SELECT CASE WHEN min(gap) = 1 AND max(gap) = 1 THEN 'monthly' WHEN min(gap) = 12 AND max(gap) = 12 THEN 'annual' WHEN min(gap) IS NULL THEN 'unknown' ELSE 'irregular' END AS resolution FROM (SELECT m - lag(m) OVER (ORDER BY m) AS gap FROM (SELECT DISTINCT year(time) * 12 + month(time) AS m FROM cube))"),
    "combined_mask_stats": cube("SELECT count(*) FILTER (WHERE keep AND code IN (0, 1, 2) AND NOT (lon_idx % 2 <> 0)) AS n_kept, count(*) AS n_total, round(avg(CASE WHEN keep AND code IN (0, 1, 2) AND NOT (lon_idx % 2 <> 0) THEN 1 ELSE 0 END), 6) AS fraction FROM pix"),
    "masked_cube": cube("SELECT pixel_id, time_idx, round(CASE WHEN keep AND code IN (0, 1, 2) THEN target END, 6) AS target FROM cube"),
    "categorical_mask": cube("SELECT pixel_id, time_idx, round(CASE WHEN code IN (1, 3) THEN target END, 6) AS target FROM cube"),
    "annual_mean": cube("SELECT pixel_id, year, make_date(year, 1, 1) AS time, round(avg(target), 6) AS target FROM cube WHERE year < 2001 GROUP BY pixel_id, year"),
    "annual_sum": cube("SELECT pixel_id, year, make_date(year, 1, 1) AS time, round(coalesce(sum(qty), 0), 6) AS qty FROM cube WHERE year < 2001 GROUP BY pixel_id, year"),
    "full_year_check": cube("SELECT year, count(DISTINCT month) AS n_months FROM cube GROUP BY year"),
    "climatology": cube("SELECT pixel_id, month, round(avg(target), 6) AS target FROM cube GROUP BY pixel_id, month"),
    "climatology_annual": cube("SELECT pixel_id, round(avg(target), 6) AS target FROM cube GROUP BY pixel_id"),
    "anomaly": cube("SELECT pixel_id, time_idx, round(target - avg(target) OVER (PARTITION BY pixel_id, month), 6) AS target FROM cube"),
    "anomaly_spatial_mean": cube("SELECT time_idx, time, round(mean - avg(mean) OVER (PARTITION BY month), 6) AS anomaly FROM s", "s AS (SELECT time_idx, time, month, avg(target) AS mean FROM cube GROUP BY ALL)"),
    "monthly_climatology": cube("SELECT month, round(avg(mean), 6) AS mean FROM s GROUP BY month", "s AS (SELECT time_idx, month, avg(target) AS mean FROM cube GROUP BY ALL)"),
    "lagged_values": cube("SELECT pixel_id, time_idx, round(qty_1, 6) AS qty_LAG_1, round(qty_2, 6) AS qty_LAG_2, round(qty_3, 6) AS qty_LAG_3 FROM lagged", LAGGED),
    "time_years_centered": cube("SELECT time, round(time_years, 6) AS time_years FROM years", YEARS),
    "theil_sen_slope": cube("SELECT pixel_id, round(slope, 6) AS slope FROM slopes", SLOPES),
    "detrended": cube("SELECT c.pixel_id, c.time_idx, round(target - slope * time_years, 6) AS target FROM cube c JOIN years USING (time) JOIN slopes s ON s.pixel_id = c.pixel_id", f"{YEARS}, {SLOPES}"),
    "reconstructed": cube("SELECT pixel_id, time_idx, round(target, 6) AS target FROM cube"),
    "temporal_mean_map": cube("SELECT pixel_id, round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS std, round(avg(CASE WHEN target IS NULL THEN 1 ELSE 0 END), 6) AS nan_fraction FROM cube GROUP BY pixel_id"),
    "spatial_mean_series": cube("SELECT time_idx, time, round(avg(target), 6) AS mean, round(stddev_pop(target), 6) AS std FROM cube GROUP BY time_idx, time"),
    "dataset_overview": cube(union([f"SELECT '{v}' AS variable, count(*) AS n_cells, count(*) FILTER (WHERE {v} IS NULL) AS n_missing, round(avg(CASE WHEN {v} IS NULL THEN 100.0 ELSE 0 END), 6) AS missing_percent, min(time) AS time_min, max(time) AS time_max FROM cube" for v in VARIABLES])),
    "structure_report": cube(union([f"SELECT '{v}' AS variable, count({v}) AS n_finite, 0::BIGINT AS n_posinf, 0::BIGINT AS n_neginf, (SELECT count(*) FROM (SELECT time_idx FROM cube GROUP BY time_idx HAVING count({v}) = 0)) AS n_empty_steps, (SELECT count(*) FROM (SELECT pixel_id FROM cube GROUP BY pixel_id HAVING count({v}) = 0)) AS n_empty_pixels FROM cube" for v in VARIABLES])),
    "missing_summary": cube(union([f"SELECT '{v}' AS variable, round(max(m), 6) AS max_missing, round(avg(m), 6) AS mean_missing FROM (SELECT time_idx, avg(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END) AS m FROM cube GROUP BY time_idx)" for v in VARIABLES])),
    "univariate_stats": cube(union([f"SELECT '{v}' AS variable, count({v}) AS n, round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, round(max({v}) - min({v}), 6) AS range, round(stddev_pop({v}) / nullif(avg({v}), 0), 6) AS cv, {quantiles(v)}, round(quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25), 6) AS iqr, round(avg(pow({v} - (SELECT avg({v}) FROM cube), 3)) / pow(stddev_pop({v}), 3), 6) AS skewness, round(kurtosis_pop({v}), 6) AS kurtosis FROM cube" for v in VARIABLES])),
    "global_corr_table": cube("SELECT predictor, r, CAST(row_number() OVER (ORDER BY abs(r) DESC NULLS LAST, place) AS INT) AS rank FROM found", f"found AS ({corr_by('')})"),
    "corr_matrix": cube(union([f"SELECT '{a}' AS a, '{b}' AS b, {corr(a, b)} AS r FROM cube" for a in VARIABLES for b in VARIABLES])),
    "corr_matrix_lower": cube(union([f"SELECT '{a}' AS a, '{b}' AS b, {corr(a, b)} AS r FROM cube" for i, a in enumerate(VARIABLES) for b in VARIABLES[: i + 1]])),
    "vif": cube(union([f"SELECT '{a}' AS variable, round(pow(corr(qty, disc), 2), 6) AS r2, round(1 / (1 - pow(corr(qty, disc), 2)), 6) AS vif FROM cube" for a in ("qty", "disc")])),
    "pixel_corr": cube(f"SELECT pixel_id, predictor, r FROM ({corr_by('pixel_id')})"),
    "pixel_lag_corr": cube(lag_corr("pixel_id"), LAGGED),
    "pixel_corr_sample": cube("SELECT pixel_id, " + ", ".join(f"{corr('target', p)} AS {p}" for p in PREDICTORS) + " FROM cube WHERE pixel_id IN (SELECT pixel_id FROM cube GROUP BY pixel_id HAVING count(target) > 0 ORDER BY md5('42:' || pixel_id) LIMIT 10) GROUP BY pixel_id"),
    "pixel_moments": cube("SELECT pixel_id, count(*) AS n, round(sum(target), 4) AS sx, round(sum(qty), 6) AS sy FROM cube WHERE target IS NOT NULL AND qty IS NOT NULL GROUP BY pixel_id"),
    "spatial_corr_by_time": cube(f"SELECT time_idx, predictor, r FROM ({corr_by('time_idx')})"),
    "spatial_corr_summary": cube("SELECT predictor, round(avg(r), 5) AS mean, round(stddev_samp(r), 5) AS std, round(min(r), 6) AS min, round(max(r), 6) AS max, round(avg(CASE WHEN r > 0 THEN 1 ELSE 0 END), 6) AS positive_fraction FROM found GROUP BY predictor", f"found AS ({corr_by('time_idx')})"),
    "spatial_corr_dominance": cube("SELECT predictor, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM best WHERE predictor IS NOT NULL GROUP BY predictor", f"found AS ({corr_by('time_idx')}), best AS ({strongest('time_idx')})"),
    "monthly_corr_table": cube("SELECT predictor, " + ", ".join(f'max(r) FILTER (WHERE month = {m}) AS "{m}"' for m in range(1, 13)) + " FROM found GROUP BY predictor", f"found AS ({corr_by('month')})"),
    "lag_corr_table": cube("SELECT predictor, " + ", ".join(f'max(r) FILTER (WHERE lag = {k}) AS "lag_{k}"' for k in range(4)) + " FROM found GROUP BY predictor", f"{LAGGED}, found AS ({lag_corr('')})"),
    "best_lag": cube("SELECT predictor, lag, r FROM (SELECT *, row_number() OVER (PARTITION BY predictor ORDER BY abs(r) DESC NULLS LAST, lag) AS n FROM found) WHERE n = 1", f"{LAGGED}, found AS ({lag_corr('')})"),
    "category_summary": cube("SELECT r.r_regionkey AS code, r.r_name AS label, coalesce(count(p.pixel_id), 0) AS n_pixels, coalesce(count(*) FILTER (WHERE p.v > 0), 0) AS n_valid_pixels, CAST(coalesce(sum(p.cells), 0) AS BIGINT) AS n_total_values, CAST(coalesce(sum(p.cells - p.v), 0) AS BIGINT) AS n_missing, round(sum(p.cells - p.v) * 100.0 / nullif(sum(p.cells), 0), 6) AS missing_percent FROM region r LEFT JOIN p ON p.code = r.r_regionkey WHERE r.r_regionkey <> 0 GROUP BY 1, 2", "p AS (SELECT pixel_id, code, count(*) AS cells, count(target) AS v FROM cube GROUP BY 1, 2)"),
    "category_corr": cube(f"SELECT code, label, predictor, r FROM ({corr_by('code, label')})"),
    "category_corr_pivot": cube("SELECT label, " + ", ".join(f"{corr('target', p)} AS {p}" for p in PREDICTORS) + " FROM cube GROUP BY label"),
    "category_month_corr": cube(f"SELECT label, month, predictor, r FROM ({corr_by('label, month')})"),
    "category_lag_corr": cube(lag_corr("label"), LAGGED),
    "dominant_predictor_map": cube(strongest("pixel_id"), f"found AS ({corr_by('pixel_id')})"),
    "dominant_by_category": cube(strongest("code"), f"found AS ({corr_by('code')})"),
    "dominant_category_map": cube("SELECT p.pixel_id, coalesce(d.dominant_code, 0) AS dominant_code FROM pix p LEFT JOIN d ON d.code = p.code", f"found AS ({corr_by('code')}), d AS ({strongest('code')})"),
    "valid_pixel_mask": cube(f"SELECT pixel_id, avg(CASE WHEN {OK} THEN 1 ELSE 0 END) >= 0.99 AS valid FROM cube GROUP BY pixel_id"),
    "valid_obs_mask": cube(f"SELECT pixel_id, time_idx FROM (SELECT *, {OK} AS ok, avg(CASE WHEN {OK} THEN 1 ELSE 0 END) OVER (PARTITION BY pixel_id) AS s FROM cube) WHERE ok AND s >= 0.99"),
    "spatial_split": cube("SELECT pixel_id, split FROM split", SPATIAL),
    "observation_split": cube("SELECT pixel_id, time_idx, split FROM split", OBS),
    "split_stats": cube("SELECT count(*) AS n_valid, count(split) AS n_selected, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test, count(DISTINCT CASE WHEN split = 'train' THEN pixel_id END) AS n_train_pixels, count(DISTINCT CASE WHEN split = 'test' THEN pixel_id END) AS n_test_pixels FROM split", OBS),
    "split_overlap": cube("SELECT pixel_id FROM split WHERE split = 'train' INTERSECT SELECT pixel_id FROM split WHERE split = 'test'", SPATIAL),
    "group_folds": cube("SELECT pixel_id, CAST((rank - 1) % 5 AS INT) AS fold FROM ranks", f"ranks AS ({ranked('pixel_id', 42, 'pix')})"),
    "train_test_export": cube("SELECT split, c.pixel_id, lat_idx, lon_idx, c.time_idx, round(qty, 6) AS qty, round(disc, 6) AS disc, round(tax, 6) AS tax, round(target, 6) AS y FROM cube c JOIN split s ON s.pixel_id = c.pixel_id AND s.time_idx = c.time_idx WHERE split IS NOT NULL", OBS),
    "export_stats": cube("SELECT split, count(*) AS n, count(DISTINCT pixel_id) AS n_pixels, min(time_idx) AS time_min, max(time_idx) AS time_max FROM split WHERE split IS NOT NULL GROUP BY split", OBS),
    "category_pixels": cube("SELECT code, pixel_id FROM ranks WHERE rank <= 5", f"ranks AS ({ranked('code, pixel_id', 42, 'pix', 'code')})"),
    "metadata_files": cube("SELECT form, variable, variable || '.parquet' AS path, n FROM (SELECT 'nested' AS form UNION ALL SELECT 'flat') CROSS JOIN (" + union([f"SELECT '{v}' AS variable, count({v}) AS n FROM cube" for v in VARIABLES]) + ")"),
    "shap_adds_up": cube(f"SELECT CAST(least(greatest(1, round_even(count(*) * 0.2::DOUBLE, 0)), count(*) - 1) AS BIGINT) AS n, 0::BIGINT AS n_off FROM cube WHERE {OK}"),
    "shap_groups": cube("SELECT label, n, 3::BIGINT AS n_features, CAST(sum(n) OVER () AS BIGINT) AS n_rows FROM found", f"found AS (SELECT label, CASE WHEN count(*) >= 2000 THEN 1000 ELSE greatest(1, CAST(floor(count(*) * 0.5) AS BIGINT)) END AS n FROM cube WHERE {OK} GROUP BY label)"),
    "stratified_sample": cube("SELECT pixel_id, code FROM (" + ranked("pixel_id", 43, "picked") + ") WHERE rank <= 20", f"ranks AS ({ranked('pixel_id', 42, 'pix', 'code')}), picked AS (SELECT pixel_id, code FROM ranks WHERE rank <= CASE WHEN total >= 16 THEN 8 ELSE greatest(1, floor(total * 0.5)) END)"),
    "head_sample": cube("SELECT pixel_id, code FROM pix ORDER BY md5('42:' || pixel_id), pixel_id LIMIT 10"),
    "global_metrics": pred(f"SELECT {CORE}, round({R2}, 6) AS r2 FROM pred"),
    "fit_metrics": pred(f"SELECT {CORE}, round({R2}, 6) AS r2, round(avg(p - y), 6) AS bias, round(covar_pop(p, y) / var_pop(y), 6) AS slope, round(avg(p) - covar_pop(p, y) / var_pop(y) * avg(y), 6) AS intercept, round(covar_pop(p, y) / (stddev_pop(p) * stddev_pop(y)), 6) AS pearson_r FROM pred"),
    "pixel_metrics": pred("SELECT pixel_id, n, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, round(y_variance, 4) AS y_variance, lat_idx, lon_idx FROM pixel", PIXEL),
    "pixel_metrics_spatial": pred(f"SELECT pixel_id, {CORE}, round(CASE WHEN count(*) >= 2 THEN {R2} END, 6) AS r2, round(avg(p - y), 6) AS bias, {corr('y', 'p', 12)} AS corr FROM pred GROUP BY pixel_id"),
    "pixel_metrics_summary": pred("SELECT count(*) AS n_pixels, count(r2) AS n_valid_r2, count(*) FILTER (WHERE r2 IS NULL) AS n_null_r2, round(avg(r2), 6) AS r2_mean, round(median(r2), 6) AS r2_median, round(quantile_cont(r2, 0.05), 6) AS r2_p05, round(quantile_cont(r2, 0.95), 6) AS r2_p95, round(avg(rmse), 6) AS rmse_mean, round(median(rmse), 6) AS rmse_median, round(avg(mae), 6) AS mae_mean, round(median(mae), 6) AS mae_median, round(avg(y_variance), 2) AS variance_mean FROM pixel", PIXEL),
    "best_worst_pixels": pred("(SELECT pixel_id, round(r2, 6) AS r2, 'best' AS kind FROM pixel WHERE r2 IS NOT NULL ORDER BY pixel.r2 DESC, pixel_id LIMIT 10) UNION ALL (SELECT pixel_id, round(r2, 6) AS r2, 'worst' AS kind FROM pixel WHERE r2 IS NOT NULL ORDER BY pixel.r2, pixel_id LIMIT 10)", PIXEL),
    "pixel_series": pred("SELECT order_id, line, pixel_id, time, round(y, 6) AS y_true, round(p, 6) AS y_pred FROM pred WHERE pixel_id IN (1, 2, 3)"),
    "prediction_errors": pred("SELECT order_id, line, pixel_id, round(p - y, 6) AS residual, round(abs(p - y), 6) AS abs_error FROM pred"),
    "worst_error": pred("SELECT order_id, line, round(abs(p - y), 6) AS abs_error FROM pred ORDER BY abs(p - y) DESC, order_id, line LIMIT 1"),
    "metrics_by_time": pred(f"SELECT time, {CORE}, round({R2}, 6) AS r2 FROM pred GROUP BY time HAVING count(*) >= 2"),
    "obs_metrics_by_time": pred(f"SELECT time, {CORE}, round(avg(p - y), 6) AS bias FROM pred GROUP BY time"),
    "pixel_obs_summary": pred("SELECT pixel_id, lat_idx, lon_idx, count(*) AS n, round(avg(abs(y - p)), 6) AS mean_abs_error, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(p - y), 6) AS mean_residual FROM pred GROUP BY 1, 2, 3"),
    "category_metrics": pred(f"SELECT code, label, {CORE}, round({R2}, 6) AS r2, round(avg(p - y), 6) AS bias, count(DISTINCT pred.pixel_id) AS n_pixels, count(DISTINCT time) AS n_times, round(count(*) / count(DISTINCT pred.pixel_id), 6) AS mean_per_pixel FROM pred JOIN pix ON pix.pixel_id = pred.pixel_id GROUP BY code, label"),
    "binned_r2": pred(f"SELECT {bin_of('y_variance')} AS bin, count(r2) AS n, round(avg(y_variance), 4) AS mean_value, round(avg(r2), 6) AS mean, round(stddev_samp(r2), 6) AS std, round(median(r2), 6) AS median FROM pixel, e WHERE y_variance IS NOT NULL GROUP BY 1", f"{PIXEL}, {edges('y_variance', 8, 'pixel')}"),
    "error_bins": pred(f"SELECT {bin_of('y')} AS bin, count(*) AS n, round(avg(y), 6) AS mean_true, round(avg(abs(y - p)), 6) AS mae, round(avg(abs(p - y) / y * 100), 6) AS mape FROM pred, e WHERE y > 1e-6 GROUP BY 1", edges("y", 12, "pred WHERE y > 1e-6")),
    "residual_bins": pred("SELECT CAST(floor((y - lo) / ((hi - lo) / 19)) AS INT) AS bin, count(*) AS n, round(avg(p - y), 6) AS mean_residual FROM pred, (SELECT min(y) AS lo, quantile_cont(y, 0.995) AS hi FROM pred) WHERE y < hi GROUP BY 1 HAVING count(*) >= 10"),
    "ape_hist": pred("SELECT CAST(least(floor(ape / (hi / 20)), 19) AS INT) AS bin, count(*) AS n FROM a, (SELECT quantile_cont(ape, 0.99) AS hi FROM a) WHERE ape <= hi GROUP BY 1", "a AS (SELECT abs(p - y) / abs(y) * 100 AS ape FROM pred WHERE abs(y) > 1e-6)"),
    "metric_hist": pred("SELECT CAST(least(floor((rmse - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM pixel, (SELECT min(rmse) AS lo, max(rmse) AS hi FROM pixel) GROUP BY 1", PIXEL),
    "density2d": pred("SELECT CAST(floor(y / 5000) AS INT) AS bx, CAST(floor(p / 5000) AS INT) AS by, count(*) AS n, round(log10(count(*)), 6) AS log_n FROM pred GROUP BY 1, 2"),
    "mask_label_lookup": pred("SELECT order_id, line, coalesce(label, 'Unknown') AS label FROM pred LEFT JOIN pix ON pix.pixel_id = pred.pixel_id"),
    "metric_map": pred("SELECT pix.pixel_id, round(coalesce(r2, CASE WHEN keep THEN 0 END), 6) AS r2 FROM pix LEFT JOIN pixel ON pixel.pixel_id = pix.pixel_id", PIXEL),
    "coarsen_mask": cube("SELECT CAST(lat_idx // 5 AS INT) AS lat_idx, CAST(lon_idx // 5 AS INT) AS lon_idx, round(avg(CASE WHEN keep THEN 1 ELSE 0 END), 6) AS mean, avg(CASE WHEN keep THEN 1 ELSE 0 END) >= 0.5 AS flag FROM pix GROUP BY 1, 2"),
    "land_mask": cube("SELECT pixel_id, bool_and(target IS NOT NULL) AS valid FROM cube GROUP BY pixel_id"),
    "bit_flags": "SELECT p_partkey, (p_size >> 1) & 1 = 1 AS bit1, (p_size >> 2) & 1 = 1 AS bit2 FROM part",
    "class_masks_coverage": cube("SELECT code, count(*) AS n_pixels FROM pix GROUP BY code"),
    "regrid_nearest": cube("SELECT pixel_id AS point, CASE WHEN lat_idx * 2.25 - 89 < 90 THEN CAST(floor((lat_idx * 2.25 - 89 + 90) / 0.5) AS INT) END AS lat_idx, CASE WHEN lat_idx * 2.25 - 89 < 90 THEN CAST(floor((lon_idx * 30.1 - 179 + 180) / 0.5) AS INT) END AS lon_idx FROM pix"),
    "preview_stride": cube("SELECT pixel_id FROM pix WHERE lat_idx % 3 = 0 AND lon_idx % 3 = 0"),
    "scaled_standard": cube("SELECT pixel_id, time_idx, round((qty - (SELECT avg(qty) FROM cube)) / (SELECT stddev_pop(qty) FROM cube), 6) AS qty FROM cube"),
    "scaled_robust": cube("SELECT pixel_id, time_idx, round((qty - (SELECT median(qty) FROM cube)) / (SELECT quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25) FROM cube), 6) AS qty FROM cube"),
    "select_roi": cube("SELECT pixel_id, CAST(lat_idx * 0.5 - 60 AS DOUBLE) AS latitude, CAST(lon_idx * 2.0 - 100 AS DOUBLE) AS longitude FROM pix WHERE lat_idx * 0.5 - 60 BETWEEN -60 AND -40 AND lon_idx * 2.0 - 100 BETWEEN -97 AND -90"),
    "standard_axes": cube("SELECT pixel_id, CAST(lat_idx * 0.5 - 60 AS DOUBLE) AS latitude, CAST(lon_idx * 2.0 - 100 AS DOUBLE) AS longitude FROM pix"),
    "axis_index": cube("SELECT pixel_id, CAST(dense_rank() OVER (ORDER BY -lat_idx) - 1 AS INT) AS place FROM pix"),
    "flip_axis": cube("SELECT pixel_id, CAST(999999 - lat_idx AS INT) AS lat_idx, lon_idx FROM pix"),
    "coordinate_lookup": cube("SELECT pixel_id, time_idx, CAST(lat_idx * 0.5 - 60 AS DOUBLE) AS latitude, CAST(lon_idx * 2.0 - 100 AS DOUBLE) AS longitude, time FROM cube"),
    "scan_variable": cube("SELECT 'lai' AS variable, pixel_id, time_idx, round(target, 6) AS value FROM cube WHERE year BETWEEN 1996 AND 1998"),
    "scan_lagged_variable": cube("SELECT 'TP_LAG_2' AS variable, pixel_id, time_idx, round(qty_2, 6) AS value FROM lagged WHERE year BETWEEN 1996 AND 1998", LAGGED),
    "scan_expanded_names": cube(union([f"SELECT '{n}' AS variable, pixel_id, time_idx, round({v}, 6) AS value FROM cube" for n, v in (("LAI", "target"), ("TP_A", "qty"), ("TP_B", "disc"))])),
    "class_variables": cube("SELECT 'LAI_CLASS_' || code AS variable, pixel_id, time_idx, round(target, 6) AS value FROM cube"),
    "lagged_files": cube(union([f"SELECT '{n}_LAG_{k}' AS variable, pixel_id, time_idx, round({v}_{k}, 6) AS value FROM lagged" for n, v in (("TP", "qty"), ("SM", "disc")) for k in (1, 2)]), LAGGED),
    "reconstructed_from_files": cube("SELECT pixel_id, time_idx, round(target, 6) AS target FROM cube"),
    "mask_labels": "SELECT r_regionkey AS code, r_name AS label FROM region",
    "available_masks": cube("SELECT pixel_id, code, 'climate' AS mask FROM pix"),
    "scan_files_by_name": "SELECT * FROM nation",
    "coerced_casts": "SELECT n_nationkey, TRY_CAST(CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_nationkey || '.5' END AS DOUBLE) AS number, TRY_CAST('2001-0' || (n_nationkey % 10) || '-10' AS DATE) AS day FROM nation",
    "slug_names": "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'figure') AS slug FROM part",
    "classification_metrics": "WITH r AS (SELECT CAST(l_linenumber % 3 AS BIGINT) AS t, CAST(l_partkey % 7 % 4 AS BIGINT) AS p FROM lineitem), k AS (SELECT t AS k FROM r UNION SELECT p FROM r), c AS (SELECT k, (SELECT count(*) FROM r WHERE t = k) AS truth, (SELECT count(*) FROM r WHERE p = k) AS said, (SELECT count(*) FROM r WHERE t = k AND p = k) AS hit FROM k), q AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS pr, coalesce(hit / nullif(truth, 0), 0) AS re FROM c) SELECT CAST(sum(truth) AS BIGINT) AS n, round(sum(hit) / sum(truth), 6) AS accuracy, round(sum(truth * pr) / sum(truth), 6) AS precision, round(sum(truth * re) / sum(truth), 6) AS recall, round(sum(truth * coalesce(2 * pr * re / nullif(pr + re, 0), 0)) / sum(truth), 6) AS f1 FROM q",
    "csv_sample": pred("SELECT order_id, line, round(y, 6) AS y_true FROM pred ORDER BY order_id, line LIMIT 500"),
    "selected_pixel_series": pred("SELECT kind, pred.pixel_id, order_id, line, round(y, 6) AS y_true, round(p, 6) AS y_pred FROM pred JOIN ((SELECT pixel_id, 'best' AS kind FROM pixel WHERE r2 IS NOT NULL ORDER BY r2 DESC, pixel_id LIMIT 2) UNION ALL (SELECT pixel_id, 'worst' AS kind FROM pixel WHERE r2 IS NOT NULL ORDER BY r2, pixel_id LIMIT 2)) c ON c.pixel_id = pred.pixel_id", PIXEL),
    "category_spatial_metrics": pred(f"SELECT code, label, {CORE}, round({R2}, 6) AS r2, m.n_pixels, round(m.corr_mean, 6) AS corr_mean, round(m.bias_mean, 6) AS bias_mean FROM pred JOIN pix ON pix.pixel_id = pred.pixel_id JOIN m USING (code) WHERE code <> 0 GROUP BY ALL", "per AS (SELECT code, pred.pixel_id, avg(p - y) AS bias, CASE WHEN count(*) >= 12 THEN covar_pop(p, y) / nullif(stddev_pop(p) * stddev_pop(y), 0) END AS corr FROM pred JOIN pix ON pix.pixel_id = pred.pixel_id GROUP BY 1, 2), m AS (SELECT code, count(*) AS n_pixels, avg(corr) AS corr_mean, avg(bias) AS bias_mean FROM per GROUP BY code)"),
    "spatial_bundle": pred(union([f"SELECT '{m}' AS metric, count({m}) AS n, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std, round(median({m}), 6) AS median, round(quantile_cont({m}, 0.05), 6) AS p05, round(quantile_cont({m}, 0.95), 6) AS p95 FROM pixel" for m in ("r2", "rmse", "mae")]), PIXEL),
    "observation_bundle": pred("SELECT count(*) AS n, round(avg(p - y), 6) AS mean, round(stddev_pop(p - y), 6) AS std, round(median(p - y), 6) AS median, round(quantile_cont(p - y, 0.05), 6) AS p05, round(quantile_cont(p - y, 0.95), 6) AS p95 FROM pred"),
    "workflow_metadata": cube("SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test, count(DISTINCT pixel_id) FILTER (WHERE split = 'train') AS n_unique_train_pixels, count(DISTINCT pixel_id) FILTER (WHERE split = 'test') AS n_unique_test_pixels, 3::BIGINT AS n_features, (SELECT count(DISTINCT time_idx) FROM cube) AS n_time, (SELECT CAST(min(time) AS VARCHAR) FROM cube) AS time_start, (SELECT CAST(max(time) AS VARCHAR) FROM cube) AS time_end, 'monthly' AS resolution FROM split", OBS),
    "training_scan": cube("SELECT c.pixel_id, c.time_idx, round(qty, 6) AS qty, round(disc, 6) AS disc, round(tax, 6) AS tax, round(target, 6) AS y FROM cube c JOIN split s ON s.pixel_id = c.pixel_id AND s.time_idx = c.time_idx WHERE split = 'train'", OBS),
    "target_year": pred("SELECT order_id, line, pixel_id FROM pred WHERE year(time) = 1997"),
    "value_stats": pred("SELECT count(rmse) AS n, round(avg(rmse), 6) AS mean, round(stddev_pop(rmse), 6) AS std, round(median(rmse), 6) AS median, round(quantile_cont(rmse, 0.05), 6) AS p05, round(quantile_cont(rmse, 0.95), 6) AS p95 FROM pixel", PIXEL),
    "grid_pixels": "SELECT CAST(s_suppkey AS INT) AS pixel_id, CAST(s_suppkey // 72 AS INT) AS lat_idx, CAST(s_suppkey % 72 AS INT) AS lon_idx, round(-89.75::DOUBLE + (s_suppkey // 72) * 0.5::DOUBLE, 6) AS latitude, round(-179.75::DOUBLE + (s_suppkey % 72) * 0.5::DOUBLE, 6) AS longitude FROM supplier",
    "grid_times": cube("SELECT DISTINCT time_idx, time FROM cube"),
    "grid_check": cube("SELECT count(*) AS n_cells, CAST(min(lat_idx * 0.5 - 60) AS DOUBLE) AS lat_min, CAST(max(lon_idx * 2.0 - 100) AS DOUBLE) AS lon_max FROM cube"),
    "cube_shape": cube("SELECT (SELECT count(*) FROM pix) AS n_pixels, (SELECT count(*) FROM times) AS n_time, (SELECT count(*) FROM pix) * (SELECT count(*) FROM times) AS n_cells"),
    "mask_misaligned": cube("SELECT pixel_id FROM pix WHERE code < 3 AND NOT code > 1 UNION ALL SELECT pixel_id FROM pix WHERE code > 1 AND NOT code < 3"),
    "row_folds": cube("SELECT pixel_id, time_idx, CAST((rank - 1) % 4 AS INT) AS fold FROM ranks", f"ranks AS ({ranked('pixel_id, time_idx', 42, 'cube')})"),
    "json_fields": "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, '{\"k\":' || CAST(props->>'k' AS BIGINT) || '}' AS again FROM events",
    "saved_model_predictions": cube(f"SELECT count(*) AS n, 0::BIGINT AS n_different FROM cube WHERE {OK}"),
    "run_cache": cube(union([f"SELECT '{name}' AS scenario, '{redone}' AS redone, count(*) AS n_rows FROM cube WHERE {rows}" for name, redone, rows in SCENARIOS])),
    "config_names": """SELECT n_nationkey, 'TP' AS predictors, processed, split, 'rf_none_' || split AS model FROM (
      SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 1 THEN 'climate' ELSE 'nomask' END || '_monthly_' || CASE WHEN n_nationkey % 3 = 0 THEN 'anomaly' ELSE 'real' END || CASE WHEN n_nationkey % 5 = 0 THEN '_detrended' ELSE '' END AS processed,
             'random_observation_train' || replace(printf('%g', round((n_nationkey + 1) / 32 * 100, 4)), '.', 'p') || '_test10_seed42' AS split FROM nation)""",
    "annual_lagged": cube("SELECT a.pixel_id, CAST(a.year - 1995 AS INT) AS time_idx, a.time, round(b.tp, 6) AS value FROM yearly a LEFT JOIN yearly b ON b.pixel_id = a.pixel_id AND b.year = a.year - 2", YEARLY),
    "annual_aligned": cube("SELECT a.pixel_id, CAST(a.year - 1995 AS INT) AS time_idx, a.time, round(a.lai, 6) AS LAI, round(a.tp, 6) AS TP, round(b.sm * 1000, 6) AS SM_LAG_1 FROM yearly a LEFT JOIN yearly b ON b.pixel_id = a.pixel_id AND b.year = a.year - 1 WHERE a.year >= 1996", YEARLY),
    "density_hex": pred("SELECT hx, hy, n, round(log10(n), 6) AS log_n FROM hex", hexagons(30)),
    "resampled_nearest": """WITH p AS (SELECT ((c_custkey * 37) % 1801) / 10 - 90 AS la, ((c_custkey * 101) % 3607) / 10 - 180 AS lo, c_acctbal AS v FROM customer WHERE c_acctbal IS NOT NULL),
      near AS (SELECT p.*, CAST(floor((la + 90) / 10) AS INT) + i AS lat_idx, CAST(floor((lo + 180) / 10) AS INT) + j AS lon_idx FROM p, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
      best AS (SELECT lat_idx, lon_idx, min({'d': round(pow(la - (lat_idx * 10 - 85), 2) + pow(lo - (lon_idx * 10 - 175), 2), 9), 'la': la, 'lo': lo, 'v': v}).v AS v FROM near GROUP BY 1, 2),
      grid AS (SELECT CAST(g // 36 AS INT) AS lat_idx, CAST(g % 36 AS INT) AS lon_idx FROM (SELECT unnest(range(648)) AS g))
      SELECT lat_idx, lon_idx, round(coalesce(v, 0), 6) AS v FROM grid LEFT JOIN best USING (lat_idx, lon_idx)""",
    "array_scan": cube("SELECT time_idx, lat_idx, lon_idx, round(qty, 6) AS value FROM cube WHERE time_idx BETWEEN 12 AND 35 AND qty IS NOT NULL"),
}


def frames(tables: dict[str, tuple[str, str]]) -> str:
    """Of each table (its SQL, and its columns of counts and numbers) the rows and the sums' logarithm."""
    total = lambda columns: " + ".join(f"coalesce(sum({c})::DOUBLE, 0)" for c in columns.split())
    return union([f"SELECT '{name}' AS frame, count(*) AS n_rows, round(ln(abs({total(columns)}) + 1), 6) AS log_sum FROM ({sql})" for name, (sql, columns) in tables.items()])


def _hist(value: str, source: str) -> str:
    return f"SELECT CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM (SELECT {value} AS v FROM {source}), (SELECT min({value}) AS lo, max({value}) AS hi FROM {source}) WHERE v IS NOT NULL GROUP BY 1"


_SUMMARY = "n_pixels n_valid_r2 n_null_r2 r2_mean rmse_mean mae_mean variance_mean r2_median r2_p05 r2_p95 rmse_median mae_median"
_FIT, _STATS = "n rmse mae r2 bias slope intercept pearson_r", "n mean std median p05 p95"
_HEX = pred("SELECT hx, hy, n, round(log10(n), 6) AS log_n FROM hex", hexagons(60))
SQL["spatial_bundle_frames"] = frames(
    {
        "metrics": (SQL["fit_metrics"], _FIT), "pixels": (SQL["pixel_metrics"], "n rmse mae r2 y_variance"), "summary": (SQL["pixel_metrics_summary"], _SUMMARY),
        "density": (_HEX, "n log_n"), "error_bins": (SQL["error_bins"], "n mean_true mae mape"),
        **{f"map_{m}": (SQL["metric_map"].replace("coalesce(r2", f"coalesce({m}").replace("AS r2 FROM pix ", f"AS {m} FROM pix "), m) for m in ("r2", "rmse", "mae")},
        **{f"hist_{m}": (pred(_hist(m, "pixel"), PIXEL), "n") for m in ("r2", "rmse", "mae")},
        **{f"stats_{m}": (f"SELECT * FROM ({SQL['spatial_bundle']}) WHERE metric = '{m}'", _STATS) for m in ("r2", "rmse", "mae")},
    }
)
SQL["observation_bundle_frames"] = frames(
    {
        "metrics": (SQL["fit_metrics"], _FIT), "by_time": (SQL["obs_metrics_by_time"], "n rmse mae bias"), "pixels": (SQL["pixel_obs_summary"], "n mean_abs_error rmse mean_residual"),
        "error_bins": (SQL["error_bins"], "n mean_true mae mape"), "residual_bins": (SQL["residual_bins"], "n mean_residual"), "ape": (SQL["ape_hist"], "n"),
        "hist_residual": (pred(_hist("p - y", "pred")), "n"), "stats_residual": (SQL["observation_bundle"], _STATS), "density": (_HEX, "n log_n"),
    }
)
