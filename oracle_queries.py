"""Independent DuckDB formulations of every SQL-checkable query in ``__spark_entry__``.

Written as a user of DuckDB would write them (``ASOF JOIN``, brute-force theta joins,
``arg_min``, ``QUALIFY``), not as a transcription of the Spark plans. Only the fixture
views are shared with the Spark side (``airfill.sources.fixtures``).
"""

from __future__ import annotations

from airfill.sources.fixtures import duckdb_with


def num(x: str) -> str:
    """Text -> finite double or NULL."""
    return f"CASE WHEN isfinite(TRY_CAST({x} AS DOUBLE)) THEN TRY_CAST({x} AS DOUBLE) END"


META = f"""meta AS (
  SELECT station_eoi,
         first(lon ORDER BY air_pollutant) FILTER (WHERE lon IS NOT NULL) AS lon,
         first(lat ORDER BY air_pollutant) FILTER (WHERE lat IS NOT NULL) AS lat,
         first(altitude ORDER BY air_pollutant) FILTER (WHERE altitude IS NOT NULL) AS altitude,
         first(station_area ORDER BY air_pollutant) FILTER (WHERE station_area IS NOT NULL) AS station_area,
         first(station_type ORDER BY air_pollutant) FILTER (WHERE station_type IS NOT NULL) AS station_type
  FROM (SELECT station_eoi, air_pollutant, {num('lat_text')} AS lat, {num('lon_text')} AS lon,
               {num('altitude_text')} AS altitude, station_area, station_type
        FROM station_points WHERE air_pollutant IN ('NO2', 'PM2.5')) p
  WHERE station_eoi IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL
  GROUP BY station_eoi)"""

LABELS = f"""labels AS (
  SELECT r.sampling_point, r.station_eoi, r.pollutant, r.value, m.lat, m.lon, m.altitude,
         m.station_area, m.station_type, substr(r.station_eoi, 1, 2) AS country,
         r.start_time, r.end_time, r.validity
  FROM (SELECT samplingpoint AS sampling_point,
               NULLIF(regexp_extract(samplingpoint, '(?:^|/)SPO-([^_/]*)[^/]*$', 1), '') AS station_eoi,
               pollutant, {num('value_text')} AS value, start_time,
               start_time + INTERVAL 1 HOUR AS end_time, CAST(validity AS BIGINT) AS validity,
               dataset, row_id
        FROM raw_readings WHERE validity >= 1 AND start_time >= TIMESTAMP '2024-01-01 00:00:00') r
  JOIN meta m ON m.station_eoi = r.station_eoi
  WHERE r.value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY r.sampling_point, r.start_time ORDER BY r.dataset DESC, r.row_id, r.validity DESC, r.value) = 1)"""

FEATS = """feats AS (
  SELECT m.station_eoi, c.valid_time, m.lat, m.lon, c.temp, c.wind_dir, c.cams_no2, c.cams_pm25
  FROM cell_weather c
  JOIN meta m ON c.clat = round((floor(m.lat / 0.25) + 0.5) * 0.25, 4)
             AND c.clon = round((floor(m.lon / 0.25) + 0.5) * 0.25, 4)
  WHERE c.cams_no2 IS NOT NULL AND c.cams_pm25 IS NOT NULL)"""

FV = """fv AS (
  SELECT l.station_eoi, l.pollutant, l.value, l.start_time, l.lat, l.lon, l.altitude,
         l.station_area, l.station_type, f.temp, f.wind_dir, f.cams_no2, f.cams_pm25
  FROM labels l ASOF JOIN feats f ON l.station_eoi = f.station_eoi AND l.start_time >= f.valid_time)"""

TS = """tb AS (
  SELECT * FROM fv
  WHERE (pollutant = 'no2' AND value > 0 AND value < 500) OR (pollutant = 'pm25' AND value > 0 AND value < 800)),
ts AS (
  SELECT *,
         round(sin(hour(start_time) * (2 * pi() / 24.0)), 6) + 0e0 AS hour_sin,
         round(cos(hour(start_time) * (2 * pi() / 24.0)), 6) + 0e0 AS hour_cos,
         round(sin(dayofyear(start_time) * (2 * pi() / 365.25)), 6) + 0e0 AS doy_sin,
         round(cos(dayofyear(start_time) * (2 * pi() / 365.25)), 6) + 0e0 AS doy_cos,
         CASE WHEN isodow(start_time) >= 6 THEN 1e0 ELSE 0e0 END AS is_weekend,
         CASE WHEN station_area = 'rural' THEN 1e0 ELSE 0e0 END AS station_area_rural,
         CASE WHEN station_area = 'suburban' THEN 1e0 ELSE 0e0 END AS station_area_suburban,
         CASE WHEN station_area = 'urban' THEN 1e0 ELSE 0e0 END AS station_area_urban,
         CASE WHEN station_type = 'background' THEN 1e0 ELSE 0e0 END AS station_type_background,
         CASE WHEN station_type = 'industrial' THEN 1e0 ELSE 0e0 END AS station_type_industrial,
         CASE WHEN station_type = 'traffic' THEN 1e0 ELSE 0e0 END AS station_type_traffic,
         CASE pollutant WHEN 'no2' THEN cams_no2 WHEN 'pm25' THEN cams_pm25 END AS prior
  FROM tb
  WHERE pollutant IN (SELECT pollutant FROM tb GROUP BY pollutant HAVING count(*) >= 500))"""

NEAREST_OTHER = """st AS (
  SELECT station_eoi, pollutant, first(lat ORDER BY start_time) AS lat, first(lon ORDER BY start_time) AS lon
  FROM ts GROUP BY station_eoi, pollutant),
nd AS (
  SELECT a.station_eoi, a.pollutant, min(sqrt(pow(b.lat - a.lat, 2) + pow(b.lon - a.lon, 2)) * 111.0) AS dist_km
  FROM st a JOIN st b ON a.pollutant = b.pollutant AND a.station_eoi <> b.station_eoi
  GROUP BY a.station_eoi, a.pollutant),
x AS (
  SELECT ts.*, nd.dist_km,
         CASE WHEN nd.dist_km > 0 AND nd.dist_km <= 10 THEN '<10'
              WHEN nd.dist_km > 10 AND nd.dist_km <= 25 THEN '10-25'
              WHEN nd.dist_km > 25 AND nd.dist_km <= 50 THEN '25-50'
              WHEN nd.dist_km > 50 AND nd.dist_km <= 100 THEN '50-100'
              WHEN nd.dist_km > 100 AND nd.dist_km <= 1e6 THEN '>100' END AS dist_bin
  FROM ts LEFT JOIN nd ON nd.station_eoi = ts.station_eoi AND nd.pollutant = ts.pollutant)"""


def _with(views, *ctes) -> str:
    return duckdb_with(*views) + "".join(f", {c}\n" for c in ctes)


_BASE = ("stations", "station_points", "raw_readings", "cell_weather")

SQL: dict[str, str] = {}

SQL["station_metadata"] = _with(("station_points",), META) + "SELECT * FROM meta"

SQL["q1_labels"] = _with(("raw_readings", "station_points"), META, LABELS) + "SELECT * FROM labels"

SQL["q2_station_features"] = _with(("station_points", "cell_weather"), META, FEATS) + "SELECT * FROM feats"

SQL["labels_from_files"] = SQL["q1_labels"]

SQL["asof_join"] = _with(_BASE, META, LABELS, FEATS, FV) + "SELECT * FROM fv"

SQL["q4_training_set"] = _with(_BASE, META, LABELS, FEATS, FV, TS) + "SELECT * FROM ts"

SQL["prior_metrics"] = _with(_BASE, META, LABELS, FEATS, FV, TS) + """
SELECT pollutant, count(*) AS n, count(DISTINCT station_eoi) AS stations,
       round(sqrt(avg(pow(prior - value, 2))), 6) AS prior_rmse,
       round(avg(abs(prior - value)), 6) AS prior_mae,
       round(1 - sum(pow(prior - value, 2)) / NULLIF(var_pop(value) * count(value), 0), 6) AS prior_r2
FROM ts GROUP BY pollutant"""

SQL["label_p99"] = _with(_BASE, META, LABELS, FEATS, FV, TS) + """
SELECT pollutant, round(quantile_cont(value, 0.99), 6) AS p99 FROM ts GROUP BY pollutant"""

SQL["mae_by_distance"] = _with(_BASE, META, LABELS, FEATS, FV, TS, NEAREST_OTHER) + """
SELECT pollutant, dist_bin, count(*) AS n, round(avg(abs(prior - value)), 6) AS prior_mae
FROM x WHERE dist_bin IS NOT NULL GROUP BY pollutant, dist_bin"""

SQL["calibration"] = _with(_BASE, META, LABELS, FEATS, FV, TS, NEAREST_OTHER) + """
, h AS (SELECT *, instr('0123456789abcdef', substr(md5(station_eoi), 1, 1)) % 2 = 0 AS odd_half FROM x WHERE dist_bin IS NOT NULL),
q AS (SELECT pollutant, dist_bin, quantile_cont(abs(prior - value), 0.9) AS q_err, count(*) AS n
      FROM h WHERE NOT odd_half GROUP BY pollutant, dist_bin)
SELECT h.pollutant, h.dist_bin, q.n, count(*) AS n_measured, round(q.q_err, 6) AS q_err,
       round(avg(CASE WHEN abs(h.prior - h.value) <= q.q_err + 1e-9 THEN 1e0 ELSE 0e0 END), 6) AS coverage
FROM h JOIN q ON q.pollutant = h.pollutant AND q.dist_bin = h.dist_bin
WHERE h.odd_half
GROUP BY h.pollutant, h.dist_bin, q.n, q.q_err"""

SQL["error_map"] = _with(_BASE, META, LABELS, FEATS, FV, TS) + """
SELECT pollutant, round((floor(lat / 0.25) + 0.5) * 0.25, 4) AS clat, round((floor(lon / 0.25) + 0.5) * 0.25, 4) AS clon,
       count(*) AS n, round(avg(prior - value), 6) AS mean_err, round(avg(abs(prior - value)), 6) AS mean_abs_err
FROM ts GROUP BY ALL"""

SQL["station_state"] = _with(("raw_readings", "station_points"), META, LABELS) + """
, recent AS (SELECT * FROM labels
             WHERE start_time >= (SELECT max(start_time) FROM labels) - INTERVAL 21 DAY
               AND pollutant IN ('pm25', 'no2')),
last AS (SELECT station_eoi, pollutant, arg_max(value, start_time) AS value, max(start_time) AS t
         FROM recent GROUP BY station_eoi, pollutant)
SELECT m.station_eoi AS eoi, round(m.lat, 4) AS lat, round(m.lon, 4) AS lon,
       coalesce(m.station_area, '') AS area, coalesce(m.station_type, '') AS type,
       round(p.value, 1) AS pm25, round(n.value, 1) AS no2,
       strftime(coalesce(p.t, n.t), '%Y-%m-%d %H:%M') AS obs_ts
FROM meta m
LEFT JOIN last p ON p.station_eoi = m.station_eoi AND p.pollutant = 'pm25'
LEFT JOIN last n ON n.station_eoi = m.station_eoi AND n.pollutant = 'no2'
WHERE substr(m.station_eoi, 1, 2) IN ('AL', 'BA', 'BE', 'LU', 'MT')"""

# ---- satellite -------------------------------------------------------------------
BOXES = """boxes AS (
  SELECT CAST(floor(lon / 5) AS BIGINT) AS tile_x, CAST(floor(lat / 5) AS BIGINT) AS tile_y,
         min(lon) - 0.5 AS box_lon0, min(lat) - 0.5 AS box_lat0,
         max(lon) + 0.5 AS box_lon1, max(lat) + 0.5 AS box_lat1
  FROM meta GROUP BY 1, 2)"""

GSEARCH = """gsearch AS (
  SELECT DISTINCT g.granule, g.product, g.sensed_at, g.name
  FROM granules g
  WHERE TRY_CAST(right(regexp_extract(g.name, '(\\d{8}T\\d{2})', 1), 2) AS INTEGER) BETWEEN 8 AND 14
    AND EXISTS (SELECT 1 FROM boxes b
                WHERE g.lon0 <= b.box_lon1 AND b.box_lon0 <= g.lon1
                  AND g.lat0 <= b.box_lat1 AND b.box_lat0 <= g.lat1))"""

CHORD = """sqrt(pow(cos(radians(m.lat)) * cos(radians(m.lon)) - cos(radians(p.lat)) * cos(radians(p.lon)), 2)
           + pow(cos(radians(m.lat)) * sin(radians(m.lon)) - cos(radians(p.lat)) * sin(radians(p.lon)), 2)
           + pow(sin(radians(m.lat)) - sin(radians(p.lat)), 2))"""

HITS = f"""px AS (
  SELECT p.* FROM pixels p JOIN gsearch g ON g.granule = p.granule
  WHERE p.value IS NOT NULL AND isfinite(p.value)
    AND p.qa >= CASE p.product WHEN 'L2__NO2___' THEN 0.75 WHEN 'L2__AER_AI' THEN 0.5 END),
hits AS (
  SELECT m.station_eoi, p.granule, p.product, CAST(date_trunc('day', p.sensed_at) AS TIMESTAMP) AS obs_date,
         p.pixel_id, p.value, {CHORD} AS c
  FROM meta m JOIN px p ON {CHORD} <= 2 * sin(8.0 / 6371.0 / 2)
  QUALIFY row_number() OVER (PARTITION BY m.station_eoi, p.granule ORDER BY c, p.pixel_id) = 1)"""

_SAT = ("station_points", "pixels", "granules")

SQL["station_boxes"] = _with(("station_points",), META, BOXES) + "SELECT * FROM boxes"

SQL["granule_search"] = _with(_SAT, META, BOXES, GSEARCH) + "SELECT * FROM gsearch"

SQL["cells_needed"] = _with(("station_points",), META) + """
SELECT round((floor(lat / 0.25e0) + 0.5e0) * 0.25e0, 4) AS clat, round((floor(lon / 0.25e0) + 0.5e0) * 0.25e0, 4) AS clon,
       count(*) AS stations
FROM meta GROUP BY 1, 2"""

SQL["days_to_do"] = _with(("raw_readings", "station_points"), META, LABELS) + """
, span AS (SELECT min(CAST(start_time AS DATE)) AS lo, max(CAST(start_time AS DATE)) AS hi FROM labels),
days AS (SELECT lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span)
SELECT day, row_number() OVER (ORDER BY day) AS place FROM days WHERE day >= lo + 10"""

SQL["packed_pixels"] = duckdb_with("pixels") + """
SELECT granule, product, pixel_id, round(qa, 2) AS qa, round(value, 12) AS value FROM pixels
WHERE value IS NOT NULL AND qa >= CASE product WHEN 'L2__NO2___' THEN 0.75 ELSE 0.5 END"""

SQL["granules_of_a_day"] = _with(_SAT, META, BOXES, GSEARCH) + """
SELECT * FROM gsearch WHERE contains(name, 'L2__NO2___') AND contains(name, 'OFFL')
  AND sensed_at >= TIMESTAMP '2024-01-03' AND sensed_at < TIMESTAMP '2024-01-04'"""

SQL["nearest_pixel"] = _with(_SAT, META, BOXES, GSEARCH, HITS) + """
SELECT station_eoi, granule, product, obs_date, pixel_id, round(value, 12) AS value,
       round(2 * 6371.0 * asin(c / 2), 6) AS dist_km
FROM hits"""

SQL["q3_satellite_daily"] = _with(_SAT, META, BOXES, GSEARCH, HITS) + """
, means AS (SELECT station_eoi, obs_date, product, avg(value) AS v FROM hits GROUP BY ALL)
SELECT m.station_eoi, d.obs_date, m.lat, m.lon,
       round(max(CASE WHEN d.product = 'L2__NO2___' THEN d.v END), 12) AS no2_column,
       round(max(CASE WHEN d.product = 'L2__AER_AI' THEN d.v END), 12) AS aerosol_index
FROM means d JOIN meta m ON m.station_eoi = d.station_eoi
GROUP BY m.station_eoi, d.obs_date, m.lat, m.lon"""

# ---- field -------------------------------------------------------------------------
GRID = """grid AS (
  SELECT i // 115 AS row, i % 115 AS col,
         round(35e0 + (i // 115) * 0.35e0, 4) AS lat, round(-10e0 + (i % 115) * 0.35e0, 4) AS lon
  FROM range(8280) t(i)),
fst AS (SELECT * FROM meta WHERE substr(station_eoi, 1, 2) IN ('AL', 'BA', 'BE', 'LU', 'MT'))"""

GDIST = """gdist AS (
  SELECT g.row, g.col, g.lat, g.lon,
         round(min(sqrt(pow((g.lon - s.lon) * 111.0 * cos(radians(g.lat)), 2) + pow((g.lat - s.lat) * 111.0, 2))), 1) AS dist_km
  FROM grid g CROSS JOIN fst s GROUP BY g.row, g.col, g.lat, g.lon)"""

WINDOW = """axis AS (SELECT min(valid_time) AS lo, date_diff('hour', min(valid_time), max(valid_time)) + 1 AS n FROM cell_weather),
win AS (
  SELECT lo + (greatest(0, n // 2 - 12)) * INTERVAL 1 HOUR AS first_hour,
         lo + (least(n - 1, n // 2 + 12)) * INTERVAL 1 HOUR AS last_hour, lo + (n // 2) * INTERVAL 1 HOUR AS now FROM axis)"""

FIELD = WINDOW + """,
cells AS (SELECT DISTINCT clat, clon, CAST(floor(clat / 0.25) AS BIGINT) * 100000 + CAST(floor(clon / 0.25) AS BIGINT) AS cell_id FROM cell_weather),
gcell AS (
  SELECT g.row, g.col, c.clat, c.clon
  FROM grid g CROSS JOIN cells c
  QUALIFY row_number() OVER (PARTITION BY g.row, g.col ORDER BY
        2 * 6371.0 * asin(sqrt(pow(sin(radians(c.clat - g.lat) / 2), 2)
        + cos(radians(g.lat)) * cos(radians(c.clat)) * pow(sin(radians(c.clon - g.lon) / 2), 2))), c.cell_id) = 1),
hours AS (SELECT unnest(generate_series(first_hour, last_hour, INTERVAL 1 HOUR)) AS valid_time FROM win),
cond AS (
  SELECT g.row, g.col, g.lat, g.lon, h.valid_time, c.temp, c.wind_dir, c.cams_pm25, c.cams_no2
  FROM grid g CROSS JOIN hours h
  LEFT JOIN gcell x ON x.row = g.row AND x.col = g.col
  LEFT JOIN cell_weather c ON c.clat = x.clat AND c.clon = x.clon AND c.valid_time = h.valid_time),
field AS (
  SELECT c.row, c.col, c.lat, c.lon, c.valid_time, v.pollutant,
         CASE WHEN c.cams_pm25 IS NOT NULL AND c.cams_no2 IS NOT NULL
              THEN round(greatest(CASE v.pollutant WHEN 'pm25' THEN c.cams_pm25 ELSE c.cams_no2 END, 0), 1) END AS value,
         d.dist_km,
         CASE WHEN d.dist_km <= 25 THEN 'sensor-verified' WHEN d.dist_km > 25 THEN 'unmonitored' END AS trust,
         'cams-prior' AS status
  FROM cond c CROSS JOIN (VALUES ('pm25'), ('no2')) v(pollutant)
  LEFT JOIN gdist d ON d.row = c.row AND d.col = c.col),
nowf AS (SELECT * FROM field WHERE valid_time = (SELECT now FROM win))"""

_FLD = ("station_points", "cell_weather")

SQL["grid_distance"] = _with(_FLD, META, GRID, GDIST) + "SELECT * FROM gdist"

SQL["field_axis"] = _with(("cell_weather",), WINDOW) + """
SELECT t.valid_time, strftime(t.valid_time, '%Y-%m-%dT%H:00') AS iso, date_diff('hour', w.now, t.valid_time) AS offset_h
FROM win w, unnest(generate_series(w.first_hour, w.last_hour, INTERVAL 1 HOUR)) AS t(valid_time)"""

SQL["q6_field"] = _with(_FLD, META, GRID, GDIST, FIELD) + "SELECT * FROM field"

# what has arrived in any order is the whole field
SQL["field_refresh"] = SQL["q6_field"]

SQL["grid_scores"] = _with(("station_points", "raw_readings", "cell_weather"), META, LABELS, GRID, GDIST, FIELD) + """
SELECT l.station_eoi, l.pollutant, f.valid_time, f.row, f.col, l.value, f.value AS estimate, round(f.value - l.value, 6) AS error, f.dist_km
FROM labels l JOIN meta m ON m.station_eoi = l.station_eoi
JOIN field f ON f.pollutant = l.pollutant AND f.valid_time = l.start_time
 AND f.row = floor((m.lat - 35) / 0.35 + 0.5) AND f.col = floor((m.lon + 10) / 0.35 + 0.5)
WHERE substr(md5(l.station_eoi), 1, 1) IN ('0', '1', '2') AND f.value IS NOT NULL AND l.value > 0
  AND l.value < CASE l.pollutant WHEN 'no2' THEN 500 ELSE 800 END"""

SQL["hotspots"] = _with(_FLD, META, GRID, GDIST, FIELD) + """
SELECT pollutant, row_number() OVER (PARTITION BY pollutant ORDER BY value DESC, lat, lon) AS rank,
       lat, lon, value, dist_km,
       printf('%d ug/m3 at %.2fN %.2fE, %d km from the nearest sensor',
              CAST(round_even(value, 0) AS BIGINT), lat, lon, CAST(round_even(dist_km, 0) AS BIGINT)) AS text
FROM nowf WHERE value IS NOT NULL AND dist_km > 25
QUALIFY rank <= 6"""

SQL["point_report"] = _with(_FLD, META, GRID, GDIST, FIELD) + """
, pts AS (
  SELECT row, col, lat, lon, max(CASE WHEN pollutant = 'pm25' THEN value END) AS pm25,
         max(CASE WHEN pollutant = 'no2' THEN value END) AS no2
  FROM nowf WHERE lat BETWEEN 34 AND 55 AND lon BETWEEN -2 AND 24
  GROUP BY row, col, lat, lon HAVING max(CASE WHEN pollutant = 'pm25' THEN value END) IS NOT NULL),
nn AS (
  SELECT p.row, p.col, s.station_eoi AS site,
         round(sqrt(pow((s.lon - p.lon) * 111.0 * cos(radians((p.lat + s.lat) / 2)), 2) + pow((s.lat - p.lat) * 111.0, 2)), 1) AS d,
         row_number() OVER (PARTITION BY p.row, p.col
                            ORDER BY sqrt(pow((s.lon - p.lon) * 111.0 * cos(radians((p.lat + s.lat) / 2)), 2) + pow((s.lat - p.lat) * 111.0, 2)), s.station_eoi) AS rank
  FROM pts p CROSS JOIN fst s
  QUALIFY rank <= 3),
agg AS (
  SELECT row, col, string_agg(site || ':' || printf('%.1f', d), ',' ORDER BY rank) AS nearest,
         max(CASE WHEN rank = 1 THEN site END) AS s1, max(CASE WHEN rank = 1 THEN d END) AS d1
  FROM nn GROUP BY row, col)
SELECT p.lat, p.lon, p.pm25 AS pm25_value, p.pm25 AS pm25_prior, p.no2 AS no2_value, p.no2 AS no2_prior,
       round(w.temp, 1) AS temp, round(w.wind_dir, 1) AS wind_dir,
       coalesce(a.nearest, '') AS nearest,
       concat_ws('; ', 'raw CAMS prior (model not registered yet)',
                 CASE WHEN a.s1 IS NOT NULL THEN printf('nearest sensor %s is %d km away', a.s1, CAST(round_even(a.d1, 0) AS BIGINT)) END,
                 CASE WHEN a.d1 > 25 THEN 'this point is effectively unmonitored' END) AS reasons
FROM pts p LEFT JOIN agg a ON a.row = p.row AND a.col = p.col
LEFT JOIN (SELECT row, col, temp, wind_dir FROM cond WHERE valid_time = (SELECT now FROM win)) w ON w.row = p.row AND w.col = p.col"""


SQL["place_report"] = _with(("station_points", "cell_weather", "places"), META, GRID, WINDOW) + """
, cells AS (SELECT DISTINCT clat, clon, CAST(floor(clat / 0.25) AS BIGINT) * 100000 + CAST(floor(clon / 0.25) AS BIGINT) AS cell_id FROM cell_weather),
inside AS (SELECT place_id, lat, lon FROM places WHERE lat BETWEEN 34 AND 55 AND lon BETWEEN -2 AND 24),
pcell AS (
  SELECT p.place_id, c.clat, c.clon
  FROM inside p CROSS JOIN cells c
  QUALIFY row_number() OVER (PARTITION BY p.place_id ORDER BY
        2 * 6371.0 * asin(sqrt(pow(sin(radians(c.clat - p.lat) / 2), 2)
        + cos(radians(p.lat)) * cos(radians(c.clat)) * pow(sin(radians(c.clon - p.lon) / 2), 2))), c.cell_id) = 1),
nn AS (
  SELECT p.place_id, s.station_eoi AS site,
         sqrt(pow((s.lon - p.lon) * 111.0 * cos(radians((p.lat + s.lat) / 2)), 2) + pow((s.lat - p.lat) * 111.0, 2)) AS d
  FROM inside p CROSS JOIN fst s
  QUALIFY row_number() OVER (PARTITION BY p.place_id ORDER BY d, s.station_eoi) <= 3),
near AS (
  SELECT place_id, string_agg(site || ':' || printf('%.1f', round(d, 1)), ',' ORDER BY d, site) AS nearest,
         first(site ORDER BY d, site) AS s1, first(round(d, 1) ORDER BY d, site) AS d1
  FROM nn GROUP BY place_id),
now_weather AS (
  SELECT x.place_id, w.temp, w.wind_dir, w.cams_pm25, w.cams_no2
  FROM pcell x JOIN cell_weather w ON w.clat = x.clat AND w.clon = x.clon
  WHERE w.valid_time = (SELECT now FROM win) AND w.cams_pm25 IS NOT NULL)
SELECT p.place_id, p.lat, p.lon,
       CASE WHEN i.place_id IS NULL THEN 'out of theatre' WHEN w.place_id IS NULL THEN 'no CAMS data here' END AS error,
       CASE WHEN w.cams_no2 IS NOT NULL THEN round(greatest(w.cams_pm25, 0), 1) END AS pm25_value, round(w.cams_pm25, 1) AS pm25_prior,
       CASE WHEN w.cams_no2 IS NOT NULL THEN round(greatest(w.cams_no2, 0), 1) END AS no2_value, round(w.cams_no2, 1) AS no2_prior,
       round(w.temp, 1) AS temp, round(w.wind_dir, 1) AS wind_dir,
       CASE WHEN w.place_id IS NOT NULL THEN coalesce(n.nearest, '') END AS nearest,
       CASE WHEN w.place_id IS NOT NULL THEN
         concat_ws('; ', 'raw CAMS prior (model not registered yet)',
                   CASE WHEN n.s1 IS NOT NULL THEN printf('nearest sensor %s is %d km away', n.s1, CAST(round_even(n.d1, 0) AS BIGINT)) END,
                   CASE WHEN n.d1 > 25 THEN 'this point is effectively unmonitored' END) END AS reasons
FROM places p LEFT JOIN inside i ON i.place_id = p.place_id LEFT JOIN now_weather w ON w.place_id = p.place_id
LEFT JOIN near n ON n.place_id = p.place_id"""


def _ramp_sql(t: str, stops, j: int) -> str:
    parts = []
    for (a0, a), (b0, b) in zip(stops[:-1], stops[1:]):
        k = f"(({t}) - {a0}e0) / {b0 - a0!r}e0"
        parts.append(f"WHEN ({t}) <= {b0}e0 THEN CAST(floor({float(a[j])!r} + {float(b[j] - a[j])!r} * {k} + 0.5) AS INTEGER)")
    return "CASE " + " ".join(parts) + f" ELSE {stops[-1][1][j]} END"


def _mosaic_sql() -> str:
    from airfill.functions.display import MEAS_STOPS, PRED_STOPS
    most = "(CASE f.pollutant WHEN 'pm25' THEN 30e0 ELSE 60e0 END)"
    t = f"least(greatest(least(1e0, f.value / {most}), 0e0), 1e0)"
    chans = []
    for j, n in enumerate("rgb"):
        chans.append(f"CASE WHEN f.dist_km <= 25 THEN {_ramp_sql(t, MEAS_STOPS, j)} "
                     f"ELSE {_ramp_sql(t, PRED_STOPS, j)} END AS {n}")
    tt = f"least(1e0, f.value / {most})"
    fade = ("CASE WHEN coalesce(f.dist_km, 9e9) <= 50 THEN 1e0 "
            "ELSE greatest(0.3e0, 1e0 - (coalesce(f.dist_km, 9e9) - 50) / 260e0) END")
    return _with(("station_points", "cell_weather", "pixels"), META, GRID, GDIST, FIELD) + f"""
, disp AS (
  SELECT pixel_id, CAST(floor((lat - 35e0) / 0.35e0 + 0.5e0) AS BIGINT) AS row,
         CAST(floor((lon - (-10e0)) / 0.35e0 + 0.5e0) AS BIGINT) AS col
  FROM pixels)
SELECT d.pixel_id, d.row, d.col, f.pollutant, f.value, f.dist_km, {", ".join(chans)},
       round((0.62e0 + 0.36e0 * sqrt({tt})) * {fade}, 4) AS alpha
FROM disp d JOIN nowf f ON f.row = d.row AND f.col = d.col
WHERE d.row BETWEEN 0 AND 71 AND d.col BETWEEN 0 AND 114 AND f.value IS NOT NULL"""


SQL["mosaic"] = _mosaic_sql()

# ---- JSON payloads ----------------------------------------------------------------------
SQL["hourly_json"] = duckdb_with("hourly_payloads") + """
, p AS (
  SELECT station_no, lat, lon, CAST(json_extract(payload, '$.elevation') AS DOUBLE) AS altitude,
         CAST(json_extract(payload, '$.hourly.time') AS VARCHAR[]) AS t,
         CAST(json_extract(payload, '$.hourly.pm2_5') AS DOUBLE[]) AS pm,
         CAST(json_extract(payload, '$.hourly.nitrogen_dioxide') AS DOUBLE[]) AS no2
  FROM hourly_payloads)
SELECT station_no, lat, lon, altitude, strptime(t[i], '%Y-%m-%dT%H:%M') AS valid_time,
       pm[i] AS cams_pm25, no2[i] AS cams_no2
FROM p, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i) r"""

# ---- evaluation ---------------------------------------------------------------------------
_EV = (_BASE, META, LABELS, FEATS, FV, TS)


def _greedy(source: str, key: str) -> str:
    """The largest group to the lightest fold, one group at a time."""
    return f"""ranked AS (
  SELECT pollutant, {key}, n, row_number() OVER (PARTITION BY pollutant ORDER BY n DESC, {key}) AS rk,
         least(5, count(*) OVER (PARTITION BY pollutant)) AS k FROM {source}),
placed(pollutant, {key}, n, rk, loads, fold) AS (
  SELECT pollutant, {key}, n, rk, list_transform(range(k), lambda i: CASE WHEN i = 0 THEN n ELSE 0 END), 0 FROM ranked WHERE rk = 1
  UNION ALL
  SELECT r.pollutant, r.{key}, r.n, r.rk,
         list_transform(range(len(p.loads)), lambda i: p.loads[i + 1] + CASE WHEN i = list_position(p.loads, list_min(p.loads)) - 1 THEN r.n ELSE 0 END),
         CAST(list_position(p.loads, list_min(p.loads)) - 1 AS INTEGER)
  FROM placed p JOIN ranked r ON r.pollutant = p.pollutant AND r.rk = p.rk + 1)"""


SQL["fold_assignment"] = _with(*_EV).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, c AS (SELECT pollutant, station_eoi, count(*) AS n FROM ts GROUP BY pollutant, station_eoi),
{_greedy('c', 'station_eoi')}
SELECT pollutant, station_eoi, n, fold FROM placed"""

SQL["spatial_folds"] = _with(*_EV).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
, g AS (SELECT pollutant, station_eoi, count(*) AS n,
               CAST(CAST(floor(any_value(lat)) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(any_value(lon)) AS BIGINT) AS VARCHAR) AS block
        FROM ts GROUP BY pollutant, station_eoi),
b AS (SELECT pollutant, block, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY pollutant, block),
{_greedy('b', 'block')}
SELECT g.pollutant, g.station_eoi, g.block, r.fold
FROM g JOIN placed r ON r.pollutant = g.pollutant AND r.block = g.block"""

HAV = """2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
         + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))"""

SQL["idw_baseline"] = _with(*_EV) + f"""
, st AS (SELECT station_eoi, pollutant, first(lat ORDER BY start_time) AS lat, first(lon ORDER BY start_time) AS lon
         FROM ts GROUP BY station_eoi, pollutant),
nb AS (SELECT a.station_eoi, a.pollutant, b.station_eoi AS site, {HAV} AS d
       FROM st a JOIN st b ON a.pollutant = b.pollutant AND a.station_eoi <> b.station_eoi
       QUALIFY row_number() OVER (PARTITION BY a.station_eoi, a.pollutant ORDER BY d, site) <= 5),
p AS (SELECT t.station_eoi, t.pollutant, t.start_time, t.value,
             coalesce(avg(o.value) FILTER (WHERE nb.d = 0),
                      sum(o.value / (nb.d * nb.d)) FILTER (WHERE nb.d > 0)
                      / sum(1 / (nb.d * nb.d)) FILTER (WHERE nb.d > 0 AND o.value IS NOT NULL)) AS idw
      FROM ts t LEFT JOIN nb ON nb.station_eoi = t.station_eoi AND nb.pollutant = t.pollutant
      LEFT JOIN ts o ON o.station_eoi = nb.site AND o.pollutant = t.pollutant AND o.start_time = t.start_time
      GROUP BY t.station_eoi, t.pollutant, t.start_time, t.value)
SELECT pollutant, count(idw) AS n, count(DISTINCT station_eoi) FILTER (WHERE idw IS NOT NULL) AS stations,
       round(sqrt(avg(pow(idw - value, 2))), 6) AS idw_rmse, round(avg(abs(idw - value)), 6) AS idw_mae,
       round(1 - sum(pow(idw - value, 2)) / NULLIF(var_pop(CASE WHEN idw IS NOT NULL THEN value END) * count(idw), 0), 6) AS idw_r2,
       count(*) - count(idw) AS without_neighbour
FROM p GROUP BY pollutant"""

SQL["training_targets"] = _with(*_EV) + """
SELECT t.station_eoi, t.pollutant, t.start_time, t.value, round(ln(1 + t.value), 6) AS log_value,
       round(t.value - t.prior, 6) AS residual, n.value AS value_next24
FROM ts t LEFT JOIN ts n ON n.station_eoi = t.station_eoi AND n.pollutant = t.pollutant
                        AND n.start_time = t.start_time + INTERVAL 24 HOUR"""

SQL["satellite_baseline"] = _with(("stations", "station_points", "raw_readings", "cell_weather", "pixels", "granules"),
                                  META, LABELS, FEATS, FV, TS, BOXES, GSEARCH, HITS) + """
, means AS (SELECT station_eoi, obs_date, product, avg(value) AS v FROM hits GROUP BY ALL),
sat AS (SELECT d.station_eoi, d.obs_date,
               round(max(CASE WHEN d.product = 'L2__NO2___' THEN d.v END), 12) AS no2_column,
               round(max(CASE WHEN d.product = 'L2__AER_AI' THEN d.v END), 12) AS aerosol_index
        FROM means d JOIN meta m ON m.station_eoi = d.station_eoi GROUP BY d.station_eoi, d.obs_date),
j AS (SELECT t.pollutant, t.value, CASE t.pollutant WHEN 'no2' THEN s.no2_column ELSE s.aerosol_index END AS x
      FROM ts t LEFT JOIN sat s ON s.station_eoi = t.station_eoi AND s.obs_date = date_trunc('day', t.start_time)),
f AS (SELECT j.*, c.intercept + c.slope * j.x AS fit
      FROM j JOIN (SELECT pollutant, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept
                   FROM j WHERE x IS NOT NULL GROUP BY pollutant) c ON c.pollutant = j.pollutant
      WHERE j.x IS NOT NULL)
SELECT pollutant, (SELECT count(*) FROM j WHERE j.pollutant = f.pollutant AND j.x IS NULL) AS without_satellite,
       count(*) AS n, round(sqrt(avg(pow(fit - value, 2))), 4) AS sat_rmse,
       round(avg(abs(fit - value)), 4) AS sat_mae,
       round(1 - sum(pow(fit - value, 2)) / NULLIF(var_pop(value) * count(value), 0), 4) AS sat_r2
FROM f GROUP BY pollutant"""

SQL["low_confidence"] = _with(("stations", "station_points", "raw_readings", "cell_weather"),
                              META, LABELS, FEATS, FV, TS, GRID, GDIST, FIELD) + """
, rng AS (SELECT pollutant, min(prior) AS p_lo, max(prior) AS p_hi, min(temp) AS t_lo, max(temp) AS t_hi
          FROM ts GROUP BY pollutant),
z AS (SELECT f.row, f.col, f.valid_time, f.pollutant, f.value, f.dist_km,
             coalesce(f.dist_km > 25, true) AS far,
             coalesce(NOT (CASE WHEN f.pollutant = 'pm25' THEN c.cams_pm25 ELSE c.cams_no2 END BETWEEN r.p_lo AND r.p_hi)
                      OR NOT (c.temp BETWEEN r.t_lo AND r.t_hi), true) AS out_rng
      FROM field f JOIN cond c ON c.row = f.row AND c.col = f.col AND c.valid_time = f.valid_time
      LEFT JOIN rng r ON r.pollutant = f.pollutant)
SELECT row, col, valid_time, pollutant, value, dist_km, far OR out_rng AS low_confidence,
       concat_ws(',', CASE WHEN far THEN 'far' END, CASE WHEN out_rng THEN 'out-of-range' END) AS why
FROM z"""


def _psi_sql(col: str, edges, name: str) -> str:
    case = "CASE " + " ".join(f"WHEN {col} < {e!r}e0 THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"
    return f"""{name}_b AS (
  SELECT pollutant, recent, {case} AS bucket FROM cut WHERE {col} IS NOT NULL),
{name}_p AS (
  SELECT pollutant, recent, bucket,
         CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY pollutant, recent) AS DOUBLE) AS p
  FROM {name}_b GROUP BY pollutant, recent, bucket),
{name} AS (
  SELECT coalesce(r.pollutant, c.pollutant) AS pollutant,
         round(sum((greatest(coalesce(c.p, 0), 1e-6) - greatest(coalesce(r.p, 0), 1e-6))
                   * ln(greatest(coalesce(c.p, 0), 1e-6) / greatest(coalesce(r.p, 0), 1e-6))), 6) AS psi
  FROM (SELECT * FROM {name}_p WHERE NOT recent) r
  FULL OUTER JOIN (SELECT * FROM {name}_p WHERE recent) c ON r.pollutant = c.pollutant AND r.bucket = c.bucket
  GROUP BY 1)"""


def _drift_sql() -> str:
    from airfill.plans.evaluation import PRIOR_EDGES, TEMP_EDGES
    return _with(*_EV, """cut AS (SELECT *, start_time >= (SELECT max(start_time) FROM ts) - INTERVAL 7 DAY AS recent FROM ts)""",
                 _psi_sql("prior", PRIOR_EDGES, "pp"), _psi_sql("temp", TEMP_EDGES, "tp")) + """
SELECT coalesce(pp.pollutant, tp.pollutant) AS pollutant, pp.psi AS psi_prior, tp.psi AS psi_temp
FROM pp FULL OUTER JOIN tp ON pp.pollutant = tp.pollutant"""


SQL["feature_drift"] = _drift_sql()

# ---- streaming (drained sinks) ----------------------------------------------------------------
SQL["stream_dedupe"] = duckdb_with("stream_readings") + """
SELECT event_id, station_eoi, pollutant, start_time, value FROM stream_readings
WHERE value IS NOT NULL AND NOT isnan(value)
QUALIFY row_number() OVER (PARTITION BY station_eoi, pollutant, start_time ORDER BY event_id) = 1"""

SQL["stream_latest"] = duckdb_with("stream_readings") + """
SELECT station_eoi, pollutant, start_time, value, event_id FROM stream_readings
QUALIFY row_number() OVER (PARTITION BY station_eoi, pollutant ORDER BY start_time DESC, event_id DESC) = 1"""

SQL["stream_hourly"] = duckdb_with("stream_readings") + """
SELECT station_eoi, pollutant, date_trunc('hour', start_time) AS window_start, count(*) AS n,
       round(sum(value) / count(*), 6) AS mean_value
FROM stream_readings GROUP BY ALL"""

# every row beside each of the 24 windows it lies in
SQL["stream_sliding"] = duckdb_with("stream_readings") + """
SELECT station_eoi, pollutant, date_trunc('hour', start_time) - i * INTERVAL 1 HOUR AS window_start, count(*) AS n,
       round(sum(value) / count(*), 6) AS mean_value
FROM stream_readings CROSS JOIN range(24) h(i) GROUP BY ALL"""

SQL["self_score"] = duckdb_with("predictions") + """
SELECT r.event_id, r.station_eoi, r.pollutant, p.valid_time, r.start_time, r.value, p.predicted, p.prior
FROM stream_readings r JOIN predictions p
  ON r.station_eoi = p.station_eoi AND r.pollutant = p.pollutant
 AND r.start_time >= p.valid_time AND r.start_time < p.valid_time + INTERVAL 1 HOUR"""

SQL["stream_enriched"] = _with(("stream_readings", "station_points", "cell_weather"), META, FEATS) + """
SELECT r.station_eoi, r.event_id, r.pollutant, r.start_time, r.value, f.temp, f.wind_dir, f.cams_no2, f.cams_pm25
FROM stream_readings r ASOF JOIN feats f ON r.station_eoi = f.station_eoi AND r.start_time >= f.valid_time"""

# ---- hex density, sinks, counts -----------------------------------------------------------------
SQL["density_hex"] = _with(*_EV) + """
, hi AS (SELECT pollutant, quantile_cont(value, 0.99) AS hi FROM ts GROUP BY pollutant),
pts AS (SELECT t.pollutant, h.hi, (t.value - 0e0) / ((h.hi - 0e0) / 45e0) AS ix,
               (t.prior - 0e0) / ((h.hi - 0e0) / 25e0) AS iy
        FROM ts t JOIN hi h ON h.pollutant = t.pollutant),
b AS (SELECT *, round_even(ix, 0) AS ix1, round_even(iy, 0) AS iy1, floor(ix) AS ix2, floor(iy) AS iy2 FROM pts),
c AS (SELECT *, pow(ix - ix1, 2) + 3e0 * pow(iy - iy1, 2) < pow(ix - ix2 - 0.5e0, 2) + 3e0 * pow(iy - iy2 - 0.5e0, 2) AS first FROM b),
d AS (SELECT pollutant, hi, CASE WHEN first THEN 1 ELSE 2 END AS lattice,
             CAST(CASE WHEN first THEN ix1 ELSE ix2 END AS BIGINT) AS i,
             CAST(CASE WHEN first THEN iy1 ELSE iy2 END AS BIGINT) AS j
      FROM c
      WHERE CASE WHEN first THEN ix1 >= 0 AND ix1 < 46 AND iy1 >= 0 AND iy1 < 26
                 ELSE ix2 >= 0 AND ix2 < 45 AND iy2 >= 0 AND iy2 < 25 END)
SELECT lattice, i, j,
       round(0e0 + (i + CASE WHEN lattice = 1 THEN 0e0 ELSE 0.5e0 END) * ((hi - 0e0) / 45e0), 4) AS cx,
       round(0e0 + (j + CASE WHEN lattice = 1 THEN 0e0 ELSE 0.5e0 END) * ((hi - 0e0) / 25e0), 4) AS cy,
       count(*) AS count, pollutant
FROM d GROUP BY pollutant, hi, lattice, i, j"""

SQL["upsert_labels"] = SQL["q1_labels"]

SQL["labels_not_stored"] = _with(("raw_readings", "station_points"), META, LABELS) + """
, first_day AS (SELECT min(CAST(start_time AS DATE)) AS d0 FROM labels),
stored AS (SELECT DISTINCT station_eoi, CAST(start_time AS DATE) AS day FROM labels, first_day
           WHERE CAST(start_time AS DATE) < d0 + 10)
SELECT l.* FROM labels l
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.station_eoi = l.station_eoi AND s.day = CAST(l.start_time AS DATE))"""

SQL["label_counts"] = _with(("raw_readings", "station_points"), META, LABELS) + """
SELECT pollutant, count(*) AS n, count(DISTINCT station_eoi) AS stations FROM labels GROUP BY pollutant"""

SQL["live_error"] = duckdb_with("predictions") + """
, s AS (SELECT r.pollutant, p.valid_time, r.value, p.predicted, p.prior
        FROM stream_readings r JOIN predictions p
          ON r.station_eoi = p.station_eoi AND r.pollutant = p.pollutant
         AND r.start_time >= p.valid_time AND r.start_time < p.valid_time + INTERVAL 1 HOUR)
SELECT pollutant, date_trunc('day', valid_time) AS window_start, count(*) AS n,
       round(sqrt(avg(pow(predicted - value, 2))), 6) AS pred_rmse,
       round(avg(abs(predicted - value)), 6) AS pred_mae,
       round(sqrt(avg(pow(prior - value, 2))), 6) AS prior_rmse
FROM s GROUP BY ALL"""

SQL["rolling_error"] = duckdb_with("predictions") + """
, s AS (SELECT r.pollutant, p.valid_time, r.value, p.predicted, p.prior
        FROM stream_readings r JOIN predictions p
          ON r.station_eoi = p.station_eoi AND r.pollutant = p.pollutant
         AND r.start_time >= p.valid_time AND r.start_time < p.valid_time + INTERVAL 1 HOUR)
SELECT pollutant, date_trunc('hour', valid_time) - i * INTERVAL 1 HOUR AS window_start, count(*) AS n,
       round(sqrt(avg(pow(predicted - value, 2))), 6) AS pred_rmse,
       round(avg(abs(predicted - value)), 6) AS pred_mae,
       round(sqrt(avg(pow(prior - value, 2))), 6) AS prior_rmse
FROM s CROSS JOIN range(24) h(i) GROUP BY ALL"""

SQL["granule_footprints"] = _with(_SAT, META, BOXES, GSEARCH) + """
SELECT g.granule, g.name,
       'POLYGON((' || g.lon0 || ' ' || g.lat0 || ',' || g.lon1 || ' ' || g.lat0 || ',' || g.lon1 || ' ' || g.lat1 || ','
       || g.lon0 || ' ' || g.lat1 || ',' || g.lon0 || ' ' || g.lat0 || '))' AS wkt,
       CAST(floor(((g.lon0 + g.lon1) / 2 + 180.0) / 360.0 * 64) AS BIGINT) AS tile_x,
       CAST(floor((1.0 - (180.0 / pi()) * ln(tan(pi() / 4 + ((g.lat0 + g.lat1) / 2) * (pi() / 360))) / 180.0) / 2.0 * 64) AS BIGINT) AS tile_y
FROM granules g WHERE g.granule IN (SELECT granule FROM gsearch)"""

# ---- context, stored series, samples --------------------------------------------------------------
def _near_km(a: str, b: str) -> str:
    return (f"2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat))"
            f" * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))")


_SNAP = "round((floor({c} / 0.25) + 0.5) * 0.25, 4)"
CONTEXT = f"""pc AS (SELECT *, {_SNAP.format(c="lat")} AS clat, {_SNAP.format(c="lon")} AS clon FROM places),
kinds AS (SELECT clat, clon, land_cover FROM pc GROUP BY clat, clon, land_cover
          QUALIFY row_number() OVER (PARTITION BY clat, clon ORDER BY count(*) DESC, land_cover) = 1),
context AS (
  SELECT p.clat, p.clon, CAST(sum(persons) AS BIGINT) AS population, CAST(sum(road_km) AS BIGINT) AS road_km,
         any_value(k.land_cover) AS land_cover, round(avg(elevation), 4) AS elevation
  FROM pc p JOIN kinds k ON k.clat = p.clat AND k.clon = p.clon GROUP BY p.clat, p.clon),
scontext AS (
  SELECT m.station_eoi, {_SNAP.format(c="m.lat")} AS clat, {_SNAP.format(c="m.lon")} AS clon, c.population, c.road_km, c.land_cover,
         c.elevation, (SELECT round(min({_near_km("m", "p")}), 6) FROM places p WHERE p.land_cover = 'MACHINERY') AS dist_point_source
  FROM meta m LEFT JOIN context c ON c.clat = {_SNAP.format(c="m.lat")} AND c.clon = {_SNAP.format(c="m.lon")})"""
_CTX = ("station_points", "places")

SQL["cell_context"] = _with(_CTX, META, CONTEXT) + "SELECT * FROM context"

SQL["station_context"] = _with(_CTX, META, CONTEXT) + "SELECT * FROM scontext"

SQL["population_by_distance"] = _with(_CTX, META, GRID) + f"""
, d AS (SELECT p.place_id, any_value(p.persons) AS persons, min({_near_km("p", "s")}) AS km FROM places p CROSS JOIN fst s GROUP BY p.place_id),
b AS (SELECT *, CASE WHEN km <= 10 THEN '<10' WHEN km <= 25 THEN '10-25' WHEN km <= 50 THEN '25-50' WHEN km <= 100 THEN '50-100'
                     WHEN km <= 1000000 THEN '>100' END AS dist_bin FROM d)
SELECT dist_bin, count(*) AS places, CAST(sum(persons) AS BIGINT) AS persons,
       round(sum(persons) / (SELECT sum(persons) FROM b), 6) AS share
FROM b GROUP BY dist_bin"""

SQL["cell_series"] = duckdb_with("weather_series", "prior_series") + """
SELECT CAST(floor(w.clat / 0.25) AS BIGINT) * 100000 + CAST(floor(w.clon / 0.25) AS BIGINT) AS cell_id, w.valid_time, temp, wind_dir,
       cams_no2, cams_pm25
FROM weather_series w JOIN prior_series p ON p.clat = w.clat AND p.clon = w.clon AND p.valid_time = w.valid_time"""

SQL["station_sample"] = _with(("station_points",), META) + """
SELECT * FROM (SELECT station_eoi, lat, lon FROM meta ORDER BY md5('42:' || station_eoi), station_eoi LIMIT 20) ORDER BY station_eoi"""

SQL["first_stations"] = _with(("station_points",), META) + "SELECT station_eoi, lat, lon FROM meta ORDER BY station_eoi LIMIT 20"

SQL["extended_features"] = _with(("stations", "station_points", "raw_readings", "cell_weather", "pixels", "granules", "places"),
                                 META, LABELS, FEATS, FV, TS, BOXES, GSEARCH, HITS, CONTEXT) + """
, means AS (SELECT station_eoi, obs_date, product, avg(value) AS v FROM hits GROUP BY ALL),
sat AS (SELECT station_eoi, obs_date, round(max(CASE WHEN product = 'L2__NO2___' THEN v END), 12) AS no2_column,
               round(max(CASE WHEN product = 'L2__AER_AI' THEN v END), 12) AS aerosol_index
        FROM means GROUP BY station_eoi, obs_date)
SELECT t.station_eoi, t.pollutant, t.start_time, t.value, t.prior, t.temp, round(sin(radians(t.wind_dir)), 6) + 0e0 AS wind_dir_sin,
       round(cos(radians(t.wind_dir)), 6) + 0e0 AS wind_dir_cos, s.no2_column, s.aerosol_index, c.population, c.land_cover, c.road_km,
       c.elevation, c.dist_point_source
FROM ts t LEFT JOIN sat s ON s.station_eoi = t.station_eoi AND s.obs_date = date_trunc('day', t.start_time)
JOIN scontext c ON c.station_eoi = t.station_eoi"""

SQL["station_file"] = _with(("station_points",), META) + """
SELECT station_eoi, lat, lon, altitude, station_area, station_type, substr(station_eoi, 1, 2) AS country,
       CASE substr(station_eoi, 1, 2) WHEN 'AL' THEN 'Albania' WHEN 'BA' THEN 'Bosnia and Herzegovina' WHEN 'BE' THEN 'Belgium'
            WHEN 'LU' THEN 'Luxembourg' WHEN 'MT' THEN 'Malta' END AS country_name
FROM meta"""

SQL["hourly_lists"] = duckdb_with("hourly_payloads") + """
, p AS (
  SELECT station_no, json_extract(payload, '$.elevation')::DOUBLE AS altitude, CAST(json_extract(payload, '$.hourly.time') AS VARCHAR[]) AS t,
         CAST(json_extract(payload, '$.hourly.pm2_5') AS DOUBLE[]) AS pm, CAST(json_extract(payload, '$.hourly.nitrogen_dioxide') AS DOUBLE[]) AS no2
  FROM hourly_payloads),
r AS (SELECT station_no - station_no % 3 AS request, row_number() OVER (PARTITION BY station_no // 3 ORDER BY station_no) - 1 AS place, * FROM p
      UNION ALL SELECT -station_no - 1, 0, * FROM p)
SELECT request, CAST(place AS INTEGER) AS place, altitude, strptime(t[i], '%Y-%m-%dT%H:%M') AS valid_time, pm[i] AS cams_pm25, no2[i] AS cams_no2
FROM r, unnest([1, 2, 3]) u(i)"""
