"""DuckDB SQL of the derived points and features, shared by the oracles."""

R = "6371000.0"


def haversine(a: str, b: str, c: str, d: str) -> str:
    x = f"pow(sin(radians({c} - {a}) / 2), 2.0) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2.0)"
    return f"(2 * {R} * atan2(sqrt(least(1.0, greatest(0.0, {x}))), sqrt(1 - least(1.0, greatest(0.0, {x})))))"


def pmod(x: str, n: str) -> str:
    return f"(({x}) - {n} * floor(({x}) / {n}))"


def bearing(a: str, b: str, c: str, d: str) -> str:
    x = f"sin(radians({d} - {b})) * cos(radians({c}))"
    y = f"cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b}))"
    return pmod(f"degrees(atan2({x}, {y})) + 360.0", "360.0")


GPS = """
gps0 AS (
  SELECT event_id, value, user_id // 5 AS tr, user_id // 15 AS us,
    date_diff('microsecond', TIMESTAMP '2024-01-01', CAST(ts AS TIMESTAMP)) // 1000 AS e_us, CAST(round(value * 100) AS BIGINT) AS v FROM events
), gps1 AS (
  SELECT *, v % 201 - 100 + CASE WHEN event_id % 997 = 0 THEN 20000 ELSE 0 END AS step_y, (v // 7) % 201 - 100 AS step_x FROM gps0
), gps2 AS (
  SELECT *, row_number() OVER w - 1 AS i, CAST(39900000 + sum(step_y) OVER w AS BIGINT) AS lat_udeg, CAST(116300000 + sum(step_x) OVER w AS BIGINT) AS lon_udeg
  FROM gps1 WINDOW w AS (PARTITION BY tr ORDER BY e_us, event_id)
), gps AS (
  SELECT CASE WHEN us > 999 THEN CAST(us AS VARCHAR) ELSE lpad(CAST(us AS VARCHAR), 3, '0') END AS user_id, CASE WHEN us > 999 THEN CAST(us AS VARCHAR) ELSE lpad(CAST(us AS VARCHAR), 3, '0') END || '__' || CASE WHEN tr > 9999 THEN CAST(tr AS VARCHAR) ELSE lpad(CAST(tr AS VARCHAR), 4, '0') END AS trajectory_id,
    i AS source_point_index, e_us + (tr % 3) * 3600000000 + CASE WHEN e_us >= 1296000000 THEN 400000000 ELSE 0 END AS elapsed_us, lat_udeg, lon_udeg,
    lat_udeg / 1e6 AS latitude, lon_udeg / 1e6 AS longitude, CASE WHEN i BETWEEN 100 AND 120 THEN 1 ELSE 0 END AS anomaly_label,
    value AS score, CAST(value > 100 AS INTEGER) AS predicted
  FROM gps2
)"""

_AT = ("l_lat", "l_lon", "latitude", "longitude")
def features(source: str = "gps", to: str = "") -> str:
    """CTEs ending in `{to}flagged`: movement features and quality flags of the points of `source`."""
    return f""",
{to}f0 AS (
  SELECT *, lag(latitude) OVER w AS l_lat, lag(longitude) OVER w AS l_lon, lag(elapsed_us) OVER w AS l_t FROM {source}
  WINDOW w AS (PARTITION BY trajectory_id ORDER BY elapsed_us, source_point_index)
), {to}f1 AS (
  SELECT *, coalesce((elapsed_us - l_t) / 1e6, 0.0) AS dt, coalesce({haversine(*_AT)}, 0.0) AS distance, {bearing(*_AT)} AS b FROM {to}f0
), {to}f2 AS (
  SELECT *, CASE WHEN dt > 0 THEN distance / dt ELSE 0.0 END AS speed,
    coalesce(last_value(CASE WHEN distance >= 1.0 THEN b END IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY elapsed_us, source_point_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS bearing
  FROM {to}f1
), {to}f3 AS (
  SELECT *, coalesce(CASE WHEN dt > 0 THEN (speed - lag(speed) OVER w) / dt END, 0.0) AS acceleration,
    coalesce(abs({pmod("bearing - lag(bearing) OVER w + 180.0", "360.0")} - 180.0), 0.0) AS turn,
    CASE WHEN l_t IS NOT NULL AND distance <= 3.0 AND speed <= 0.5 THEN 1 ELSE 0 END AS stop, row_number() OVER w AS rn
  FROM {to}f2 WINDOW w AS (PARTITION BY trajectory_id ORDER BY elapsed_us, source_point_index)
), {to}f4 AS (
  SELECT *, sum(1 - stop) OVER (PARTITION BY trajectory_id ORDER BY elapsed_us, source_point_index) AS run FROM {to}f3
), {to}feat AS (
  SELECT *, CASE WHEN stop = 1 THEN sum(dt * stop) OVER (PARTITION BY trajectory_id, run ORDER BY elapsed_us, source_point_index) ELSE 0.0 END AS stop_s FROM {to}f4
), {to}flag0 AS (
  SELECT *, dt <= 0 AND rn > 1 AS is_invalid_time, dt > 300.0 AS is_long_gap, speed > 50.0 AS is_unrealistic_speed, distance > 1000.0 AND dt > 0 AND dt <= 60.0 AS is_gps_jump, rn = 1 AS is_first FROM {to}feat
), {to}flagged AS (
  SELECT *, is_invalid_time OR is_long_gap OR is_unrealistic_speed OR is_gps_jump AS is_low_quality,
    concat_ws(';', CASE WHEN is_invalid_time THEN 'invalid_time' END, CASE WHEN is_long_gap THEN 'long_gap' END, CASE WHEN is_unrealistic_speed THEN 'unrealistic_speed' END, CASE WHEN is_gps_jump THEN 'gps_jump' END) AS quality_reason,
    NOT (is_invalid_time OR is_long_gap OR is_unrealistic_speed OR is_gps_jump) AND rn > 1 AS is_training_eligible FROM {to}flag0
)"""


FEATURES = GPS + features()

#: CTEs after GPS, ending in `split`.
SPLITS = """, u AS (SELECT DISTINCT user_id FROM gps), r AS (SELECT user_id, row_number() OVER (ORDER BY sha256('42|' || user_id), user_id) AS i, count(*) OVER () AS n FROM u),
split AS (SELECT user_id, CASE WHEN i <= n - 2 * greatest(1, round_even(n * 0.2, 0)) THEN 'train' WHEN i <= n - greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'test' END AS dataset_split FROM r)"""


def draw(k: int, bound: str, more: str = "") -> str:
    """A whole number below `bound` from SHA-256 of the seed, trajectory, type (and index) and k."""
    return f"(CAST('0x' || substr(sha256('42|' || trajectory_id || '|' || anomaly_type || '|' || {more} '{k}'), 1, 15) AS BIGINT) % ({bound}))"


_POINT = "CAST(source_point_index AS VARCHAR) || '|' ||"
_PART = "WINDOW p AS (PARTITION BY trajectory_id, anomaly_type)"
_PI = "3.141592653589793"
#: CTEs after FEATURES, ending in `copies`: four injected copies of each trajectory of a validation or test user, and their features in `c_flagged`.
COPIES = SPLITS + f""", own AS (SELECT f.*, dataset_split FROM flagged f JOIN split USING (user_id) WHERE dataset_split <> 'train'),
g0 AS (SELECT trajectory_id, count(*) AS n FROM own GROUP BY 1 HAVING count(*) >= 12),
g1 AS (SELECT *, 10 + {draw(1, "least(30, n - 2) - 9")} AS len FROM (SELECT *, unnest(['route_deviation', 'abnormal_speed', 'long_stop', 'direction_change']) AS anomaly_type FROM g0)),
seg AS (SELECT *, 1 + {draw(2, "n - len - 1")} AS start FROM g1),
i0 AS (SELECT o.*, anomaly_type, n, len, start, max(CASE WHEN source_point_index = start THEN elapsed_us END) OVER p AS t_s FROM own o JOIN seg USING (trajectory_id) {_PART}),
i1 AS (SELECT *, min(CASE WHEN source_point_index >= start + len - 1 AND elapsed_us - t_s >= 120000000 THEN source_point_index END) OVER p AS reach FROM i0 {_PART}),
i2 AS (SELECT *, CASE WHEN anomaly_type = 'long_stop' THEN least(n - 1, coalesce(reach + 1, n - 1)) ELSE start + len END AS seg_stop FROM i1),
i3 AS (SELECT *, source_point_index >= start AND source_point_index < seg_stop AS inside, max(CASE WHEN source_point_index = start THEN latitude END) OVER p AS lat_s, max(CASE WHEN source_point_index = start THEN longitude END) OVER p AS lon_s,
  max(CASE WHEN source_point_index = seg_stop - 1 THEN latitude END) OVER p AS lat_e, max(CASE WHEN source_point_index = seg_stop - 1 THEN longitude END) OVER p AS lon_e,
  quantile_cont(CASE WHEN source_point_index >= start AND source_point_index < seg_stop AND speed > 0 THEN speed END, 0.5) OVER p AS med, {draw(3, "1000000")} / 1e6 AS u, {draw(4, "1000000", _POINT)} / 1e6 AS v FROM i2 {_PART}),
i4 AS (SELECT *, atan2(lat_e - lat_s, (lon_e - lon_s) * cos(radians(lat_s))) AS heading, (100 + 200 * u) * sin({_PI} * (source_point_index - start) / greatest(seg_stop - start - 1, 1)) AS push,
  least(45.0, greatest(10.0, coalesce(med, 3.0) * (3 + 2 * u))) AS target FROM i3),
i5 AS (SELECT *, CASE WHEN NOT inside THEN latitude WHEN anomaly_type = 'route_deviation' THEN latitude - cos(heading) * push / 111320.0 WHEN anomaly_type = 'long_stop' THEN lat_s + (2 * v - 1) / 111320.0
    WHEN anomaly_type = 'direction_change' THEN latitude + CASE WHEN (source_point_index - start) % 2 = 0 THEN 1 ELSE -1 END * (15 + 25 * u) / 111320.0 ELSE latitude END AS lat_new,
  CASE WHEN inside AND anomaly_type = 'abnormal_speed' THEN CAST(round(greatest(greatest(distance, 0.001) / target, 0.001) * 1e6) AS BIGINT)
    ELSE coalesce(elapsed_us - lag(elapsed_us) OVER (PARTITION BY trajectory_id, anomaly_type ORDER BY source_point_index), 0) END AS step_us FROM i4),
copies AS (SELECT user_id, dataset_split, trajectory_id || '__' || anomaly_type || '__01' AS trajectory_id, trajectory_id AS source_trajectory_id, anomaly_type, source_point_index, CAST(inside AS INTEGER) AS anomaly_label, start AS segment_start, seg_stop AS segment_end, score,
  CAST(min(elapsed_us) OVER (PARTITION BY trajectory_id, anomaly_type) + sum(step_us) OVER (PARTITION BY trajectory_id, anomaly_type ORDER BY source_point_index) AS BIGINT) AS elapsed_us, lat_new AS latitude,
  CASE WHEN inside AND anomaly_type = 'route_deviation' THEN longitude + sin(heading) * push / (111320.0 * greatest(1e-6, cos(radians(lat_new))))
    WHEN inside AND anomaly_type = 'long_stop' THEN lon_s + (2 * v - 1) / (111320.0 * greatest(1e-6, cos(radians(lat_s)))) ELSE longitude END AS longitude FROM i5)""" + features("copies", "c_")
COPIED = FEATURES + COPIES

LINKED = GPS + """,
linked AS (
  SELECT *, elapsed_us - lag(elapsed_us) OVER w AS gap_us,
    coalesce(source_point_index - lag(source_point_index) OVER w = 1 AND elapsed_us - lag(elapsed_us) OVER w BETWEEN 1 AND 300000000, false) AS linked
  FROM gps WINDOW w AS (PARTITION BY trajectory_id ORDER BY source_point_index)
)"""


def runs(name: str, flag: str, source: str = "linked") -> str:
    """CTEs ending in `name`: runs of linked points with flag = 1."""
    return f""",
{name}_a AS (
  SELECT *, coalesce({flag} = 1, false) AS is_on, coalesce(lag({flag}) OVER (PARTITION BY trajectory_id ORDER BY source_point_index) = 1, false) AS was_on FROM {source}
), {name}_b AS (
  SELECT *, sum(CASE WHEN is_on AND NOT (linked AND was_on) THEN 1 ELSE 0 END) OVER (PARTITION BY trajectory_id ORDER BY source_point_index) AS run_id FROM {name}_a
), {name} AS (
  SELECT trajectory_id, min(source_point_index) AS start_index, max(source_point_index) AS end_index, count(*) AS points, (max(elapsed_us) - min(elapsed_us)) / 1e6 AS duration_s
  FROM {name}_b WHERE is_on GROUP BY trajectory_id, run_id
)"""


def gate(window: int, votes: int) -> str:
    """CTEs ending in `gated`."""
    return LINKED + f""",
blocks AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY trajectory_id ORDER BY source_point_index) AS block FROM linked),
voted AS (
  SELECT *, CAST(sum(predicted) OVER (PARTITION BY trajectory_id, block ORDER BY source_point_index ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS votes,
    row_number() OVER (PARTITION BY trajectory_id, block ORDER BY source_point_index) >= {window} AS supported FROM blocks
), gate0 AS (SELECT *, supported AND votes >= {votes} AS gate FROM voted),
gated AS (
  SELECT *, gate AND NOT (coalesce(lag(gate) OVER (PARTITION BY trajectory_id ORDER BY source_point_index), false) AND linked) AS candidate FROM gate0
)"""


def cooled(seconds: int) -> str:
    """Recursive CTEs after `gated`, ending in `cooled`: the greedy cooldown."""
    return f""",
cand AS (SELECT trajectory_id, source_point_index, elapsed_us, row_number() OVER (PARTITION BY trajectory_id ORDER BY source_point_index) AS n FROM gated WHERE candidate),
cooled AS (
  SELECT trajectory_id, source_point_index, elapsed_us, n, true AS emitted, elapsed_us AS at, source_point_index AS idx, CAST(NULL AS BIGINT) AS suppressor_index FROM cand WHERE n = 1
  UNION ALL
  SELECT c.trajectory_id, c.source_point_index, c.elapsed_us, c.n, c.elapsed_us - p.at >= {seconds}000000,
    CASE WHEN c.elapsed_us - p.at >= {seconds}000000 THEN c.elapsed_us ELSE p.at END, CASE WHEN c.elapsed_us - p.at >= {seconds}000000 THEN c.source_point_index ELSE p.idx END,
    CASE WHEN c.elapsed_us - p.at >= {seconds}000000 THEN NULL ELSE p.idx END
  FROM cooled p JOIN cand c ON c.trajectory_id = p.trajectory_id AND c.n = p.n + 1
)"""
