"""SQL counterparts of the registered queries, for DuckDB over views of the test tables."""

from __future__ import annotations

from ..contract import CATEGORICAL, DELAY_CAUSES, MODEL_FEATURES_V2, PROFILE_PERCENTILES, SWEEP_BOOSTED, SWEEP_FINAL, SWEEP_FOREST_V1, TEST_TABLES

P = TEST_TABLES


def _round(expression: str, digits: int) -> str:
    """Rounding of the decimal text of a double, half away from zero."""
    return f"CAST(round(CAST(CAST(({expression}) AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def _r2(expression: str) -> str:
    return _round(expression, 2)


def _r6(expression: str) -> str:
    return _round(expression, 6)


_CTES: dict[str, str] = {
    "trips": """
        SELECT d AS fl_date, CAST(month(d) AS INTEGER) AS month, CAST(isodow(d) AS INTEGER) AS day_of_week, carrier AS op_unique_carrier,
            origin, origin AS origin_city_name, state AS origin_state_nm, dest, crs_dep_time,
            CASE WHEN cancelled = 0 THEN coalesce(arr, 0) - n + 3 END AS dep_delay, arr AS arr_delay,
            CASE WHEN cancelled = 0 THEN 10 + n END AS taxi_out,
            CASE WHEN cancelled = 0 THEN CAST(3 + s % 8 AS INTEGER) END AS taxi_in,
            CASE WHEN cancelled = 0 AND diverted = 0 THEN CAST(floor(distance / 8) AS INTEGER) + 20 END AS air_time,
            CASE WHEN cancelled = 0 AND diverted = 0 THEN CAST(floor(distance / 8) AS INTEGER) + 33 + n + CAST(s % 8 AS INTEGER) END AS actual_elapsed_time,
            distance, cancelled, diverted,
            CASE WHEN cancelled = 1 THEN substr('ABCD', CAST(p % 4 + 1 AS INTEGER), 1) END AS cancellation_code,
            CASE WHEN arr >= 15 THEN CASE WHEN s % 3 = 0 THEN arr ELSE 0 END END AS carrier_delay,
            CASE WHEN arr >= 15 THEN CASE WHEN s % 3 = 1 THEN arr ELSE 0 END END AS weather_delay,
            CASE WHEN arr >= 15 THEN CASE WHEN s % 3 = 2 THEN arr ELSE 0 END END AS nas_delay,
            CASE WHEN arr >= 15 THEN 0 END AS security_delay,
            CASE WHEN arr >= 15 THEN 0 END AS late_aircraft_delay
        FROM (
            SELECT *, CASE WHEN cancelled = 0 AND diverted = 0 THEN CAST(l_quantity AS INTEGER) - 35 + CAST((p % 25) % 24 AS INTEGER) END AS arr
            FROM (
                SELECT CAST(l_shipdate AS DATE) AS d, p_brand AS carrier, sn.n_name AS origin, sr.r_name AS state, cn.n_name AS dest,
                    l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_quantity,
                    CAST(CASE WHEN l_partkey % 25 = 24 THEN 2400 ELSE (l_partkey % 25) * 100 + l_orderkey % 60 END AS INTEGER) AS crs_dep_time,
                    CAST(floor(l_extendedprice / 40) AS INTEGER) AS distance,
                    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1 THEN 1 ELSE 0 END AS cancelled,
                    CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 7 THEN 1 ELSE 0 END AS diverted
                FROM lineitem
                JOIN orders ON o_orderkey = l_orderkey
                JOIN supplier ON s_suppkey = l_suppkey
                JOIN nation sn ON sn.n_nationkey = s_nationkey
                JOIN region sr ON sr.r_regionkey = sn.n_regionkey
                JOIN customer ON c_custkey = o_custkey
                JOIN nation cn ON cn.n_nationkey = c_nationkey
                JOIN part ON p_partkey = l_partkey
            )
        )""",
    "silver": f"""
        SELECT *, CASE WHEN hh < 6 THEN 'Night' WHEN hh < 12 THEN 'Morning' WHEN hh < 18 THEN 'Afternoon' ELSE 'Evening' END AS departure_period,
            hh AS scheduled_dep_hour, crs_dep_time_clean % 100 AS scheduled_dep_minute
        FROM (
            SELECT *, crs_dep_time_clean // 100 AS hh FROM (
                SELECT *, CASE WHEN crs_dep_time = 2400 THEN 0 ELSE crs_dep_time END AS crs_dep_time_clean,
                    CASE WHEN cancelled = 1 THEN 'Cancelled' WHEN diverted = 1 THEN 'Diverted' ELSE 'Completed' END AS flight_status,
                    CASE WHEN arr_delay >= {P.delay_minutes} THEN 1 WHEN arr_delay IS NOT NULL THEN 0 END AS is_delayed,
                    origin || '_' || dest AS route
                FROM trips
            )
        )""",
    "completed": """
        SELECT *, CASE WHEN day_of_week IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
            date_diff('day', DATE '1970-01-01', fl_date) AS dayno,
            date_diff('day', DATE '1970-01-01', fl_date) * 86400 + scheduled_dep_hour * 3600 + scheduled_dep_minute * 60 AS flight_timestamp
        FROM silver WHERE flight_status = 'Completed'""",
    "parts": f"""
        SELECT *, CASE WHEN fl_date < DATE '{P.train_end}' THEN 'train' WHEN fl_date < DATE '{P.validation_end}' THEN 'validation' ELSE 'test' END AS part
        FROM completed""",
}

SILVER_COLUMNS = [
    "fl_date", "month", "day_of_week", "op_unique_carrier", "origin", "origin_city_name", "origin_state_nm", "dest",
    "crs_dep_time", "dep_delay", "arr_delay", "taxi_out", "taxi_in", "air_time", "actual_elapsed_time", "distance",
    "cancelled", "diverted", "cancellation_code", "carrier_delay", "weather_delay", "nas_delay", "security_delay",
    "late_aircraft_delay", "flight_status", "scheduled_dep_hour", "scheduled_dep_minute", "is_delayed",
    "crs_dep_time_clean", "route", "departure_period",
]
DAY = "CAST(fl_date AS VARCHAR) AS fl_date"
KEYS = {"route": "route", "origin": "origin", "carrier": "op_unique_carrier"}
CONTEXTS = {
    "origin_hour": ("origin", "scheduled_dep_hour", True),
    "route_hour": ("route", "scheduled_dep_hour", True),
    "carrier_hour": ("op_unique_carrier", "scheduled_dep_hour", True),
    "origin_dow": ("origin", "day_of_week", False),
    "route_dow": ("route", "day_of_week", False),
}


def _day_history(name: str) -> str:
    key = KEYS[name]
    return f"""
        SELECT fl_date AS day_{name}, {key} AS key_{name},
            CAST(sum(n) OVER before AS BIGINT) AS historical_{name}_flights,
            sum(d) OVER before / sum(n) OVER before AS historical_{name}_delay_rate,
            CAST(sum(n) OVER week AS BIGINT) AS {name}_flights_last_7d,
            sum(d) OVER week / sum(n) OVER week AS {name}_delay_rate_last_7d
        FROM (SELECT fl_date, dayno, {key}, count(*) AS n, sum(is_delayed) AS d FROM completed GROUP BY ALL)
        WINDOW before AS (PARTITION BY {key} ORDER BY fl_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            week AS (PARTITION BY {key} ORDER BY dayno RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)"""


for _name in KEYS:
    _CTES[f"day_{_name}"] = _day_history(_name)

_CTES["v1"] = f"""
    SELECT c.*, day_route.* EXCLUDE (day_route, key_route), day_origin.* EXCLUDE (day_origin, key_origin), day_carrier.* EXCLUDE (day_carrier, key_carrier),
        {', '.join(f'CASE WHEN historical_{n}_flights >= {P.reliable_min} THEN historical_{n}_delay_rate END AS reliable_{n}_delay_rate' for n in KEYS)},
        {', '.join(f'CASE WHEN historical_{n}_flights > 0 THEN 1 ELSE 0 END AS has_{n}_history' for n in KEYS)},
        {_r6('sin(2 * pi() * scheduled_dep_hour / 24)')} AS dep_hour_sin, {_r6('cos(2 * pi() * scheduled_dep_hour / 24)')} AS dep_hour_cos,
        {_r6('sin(2 * pi() * month / 12)')} AS month_sin, {_r6('cos(2 * pi() * month / 12)')} AS month_cos
    FROM completed c
    LEFT JOIN day_route ON day_route.day_route = c.fl_date AND key_route = c.route
    LEFT JOIN day_origin ON day_origin.day_origin = c.fl_date AND key_origin = c.origin
    LEFT JOIN day_carrier ON day_carrier.day_carrier = c.fl_date AND key_carrier = c.op_unique_carrier"""


def _context_windows(source: str, names: list[str]) -> str:
    columns, windows = [], []
    for n in names:
        key, by, week = CONTEXTS[n]
        columns.append(f"CAST(count(*) OVER {n} AS BIGINT) AS historical_{n}_flights, sum(is_delayed) OVER {n} / nullif(count(*) OVER {n}, 0) AS historical_{n}_delay_rate")
        frame = f"PARTITION BY {key}, {by} ORDER BY flight_timestamp RANGE BETWEEN"
        windows.append(f"{n} AS ({frame} UNBOUNDED PRECEDING AND 1 PRECEDING)")
        if week:
            columns.append(f"CAST(count(*) OVER {n}_7 AS BIGINT) AS {n}_flights_last_7d, sum(is_delayed) OVER {n}_7 / nullif(count(*) OVER {n}_7, 0) AS {n}_delay_rate_last_7d")
            windows.append(f"{n}_7 AS ({frame} 604800 PRECEDING AND 1 PRECEDING)")
    reliable = ", ".join(
        f"CASE WHEN historical_{n}_flights >= {P.reliable_min} THEN historical_{n}_delay_rate END AS reliable_{n}_delay_rate" for n in names
    )
    return f"SELECT *, {reliable} FROM (SELECT *, {', '.join(columns)} FROM {source} WINDOW {', '.join(windows)})"


_CTES["v2"] = _context_windows("v1", list(CONTEXTS))
_CTES["contexts"] = _context_windows("completed", list(CONTEXTS))
_CTES["origin_hours"] = _context_windows("completed", ["origin_hour"])
_CTES["predictions"] = f"""
    SELECT fl_date, op_unique_carrier, origin, dest, route, scheduled_dep_hour, distance, is_delayed, delay_probability,
        CASE WHEN delay_probability >= {P.threshold} THEN 1 ELSE 0 END AS predicted_delay,
        CASE WHEN delay_probability <= {P.risk_edges[0]} THEN 'Low' WHEN delay_probability <= {P.risk_edges[1]} THEN 'Medium' ELSE 'High' END AS risk_category
    FROM (
        SELECT *, coalesce(reliable_origin_hour_delay_rate, (SELECT avg(is_delayed) FROM completed WHERE fl_date < DATE '{P.train_end}')) AS delay_probability
        FROM origin_hours WHERE fl_date >= DATE '{P.validation_end}'
    )"""
_CTES["outcomes"] = """
    SELECT CAST(count(*) FILTER (WHERE is_delayed = 1 AND predicted_delay = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE is_delayed = 0 AND predicted_delay = 1) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (WHERE is_delayed = 0 AND predicted_delay = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE is_delayed = 1 AND predicted_delay = 0) AS DOUBLE) AS fn
    FROM predictions"""
_CTES["scores"] = "SELECT delay_probability AS s, sum(is_delayed) AS pos, sum(1 - is_delayed) AS neg FROM predictions GROUP BY ALL"
_CTES["ranked"] = "SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM scores WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

# What each common table expression reads.
_NEEDS = {
    "trips": [], "silver": ["trips"], "completed": ["silver"], "parts": ["completed"],
    "day_route": ["completed"], "day_origin": ["completed"], "day_carrier": ["completed"],
    "v1": ["day_route", "day_origin", "day_carrier"], "v2": ["v1"], "contexts": ["completed"], "origin_hours": ["completed"],
    "predictions": ["origin_hours"], "outcomes": ["predictions"], "scores": ["predictions"], "ranked": ["scores"],
}


def _with(select: str, *names: str) -> str:
    """The SELECT with the expressions it reads, and theirs, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS[name]:
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return f"WITH {', '.join(f'{n} AS MATERIALIZED ({_CTES[n]})' for n in order)} {select}"


def _stats(keys: str, delay: str = "arr_delay", extra: str = "", tail: str = "", source: str = "completed") -> str:
    return _with(
        f"""SELECT {keys}, count(*) AS flights, {_r2(f'avg({delay})')} AS avg_{delay}, {extra}
            {_r2('avg(is_delayed) * 100')} AS delay_rate_pct FROM {source} GROUP BY {keys} {tail}""",
        "completed",
    )


def _risk(key: str, tail: str = "", predicted: bool = False, shown: str | None = None) -> str:
    more = f"{_r6('avg(predicted_delay)')} AS predicted_delay_rate, {_r2('avg(predicted_delay) * 100')} AS predicted_delay_rate_pct," if predicted else ""
    return _with(
        f"""SELECT {shown or key}, count(*) AS total_flights, CAST(sum(is_delayed) AS BIGINT) AS actual_delays, CAST(sum(predicted_delay) AS BIGINT) AS predicted_delays,
            {_r6('avg(is_delayed)')} AS actual_delay_rate, {more} {_r6('avg(delay_probability)')} AS avg_risk,
            {_r2('avg(is_delayed) * 100')} AS actual_delay_rate_pct, {_r2('avg(delay_probability) * 100')} AS avg_risk_pct
            FROM predictions GROUP BY {key} {tail}""",
        "predictions",
    )


def _share(key: str, source: str, within: str = "", shown: str | None = None) -> str:
    groups = f"{within + ', ' if within else ''}{key}"
    over = f"PARTITION BY {within}" if within else ""
    return f"""SELECT {groups}, flights, {_r2(f'flights / CAST(sum(flights) OVER ({over}) AS DOUBLE) * 100')} AS percentage
        FROM (SELECT {groups}, count(*) AS flights FROM {source} GROUP BY ALL)"""


def _summary(columns: list[str], source: str) -> str:
    rows = [
        f"""SELECT '{c}' AS column_name, count({c}) AS n, {_r6(f'avg({c})')} AS mean, {_r6(f'stddev_samp({c})')} AS stddev, CAST(min({c}) AS DOUBLE) AS min,
            {_r6(f'quantile_cont({c}, 0.25)')} AS p25, {_r6(f'quantile_cont({c}, 0.5)')} AS p50, {_r6(f'quantile_cont({c}, 0.75)')} AS p75, CAST(max({c}) AS DOUBLE) AS max FROM {source}"""
        for c in columns
    ]
    return _with(" UNION ALL ".join(rows), source)


def _counts(column: str, limit: str = "") -> str:
    return _with(f"SELECT {column}, count(*) AS n FROM silver GROUP BY {column} ORDER BY n DESC, {column} {limit}", "silver")


def _table_shapes() -> str:
    tables = (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
        "pages", "benchmark", "labels", "conversations",
    )
    shapes = "(SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns"
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, {shapes.format(t=t)}" for t in tables)


def _quality_sql(tp: str, fp: str, fn: str) -> list[str]:
    return [
        f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)",
        f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)",
        f"coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)",
    ]


def _report_sql() -> str:
    zero, one = _quality_sql("tn", "fn", "fp"), _quality_sql("tp", "fp", "fn")
    names = ("precision", "recall", "f1")
    accuracy = "(tp + tn) / (tp + fp + tn + fn)"
    rows = {
        "0": (zero, "tn + fp"),
        "1": (one, "tp + fn"),
        "accuracy": ([accuracy] * 3, "tp + fp + tn + fn"),
        "macro avg": ([f"({a} + {b}) / 2" for a, b in zip(zero, one)], "tp + fp + tn + fn"),
        "weighted avg": (
            [f"({a}) * ((tn + fp) / (tp + fp + tn + fn)) + ({b}) * ((tp + fn) / (tp + fp + tn + fn))" for a, b in zip(zero, one)],
            "tp + fp + tn + fn",
        ),
    }
    selects = [
        f"SELECT '{label}' AS class, {', '.join(f'{_r6(v)} AS {n}' for v, n in zip(values, names))}, CAST({support} AS BIGINT) AS support FROM outcomes"
        for label, (values, support) in rows.items()
    ]
    return _with(" UNION ALL ".join(selects), "outcomes")


def _sweep_sql(thresholds: tuple[float, ...]) -> str:
    selects = []
    for t in thresholds:
        p, r, f = _quality_sql("tp", "fp", "fn")
        selects.append(
            f"""SELECT CAST({t} AS DOUBLE) AS threshold, {p} AS precision, {r} AS recall, {f} AS f1 FROM (
                SELECT CAST(count(*) FILTER (WHERE is_delayed = 1 AND delay_probability >= {t}) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE is_delayed = 0 AND delay_probability >= {t}) AS DOUBLE) AS fp,
                CAST(count(*) FILTER (WHERE is_delayed = 1 AND delay_probability < {t}) AS DOUBLE) AS fn FROM predictions)"""
        )
    return _with(" UNION ALL ".join(selects), "predictions")


def _profile_sql() -> str:
    parts = {
        "count": "CAST(count(delay_probability) AS DOUBLE)", "mean": "avg(delay_probability)", "std": "stddev_samp(delay_probability)",
        "min": "min(delay_probability)", **{f"{p:.0%}": f"quantile_cont(delay_probability, {p})" for p in PROFILE_PERCENTILES}, "max": "max(delay_probability)",
    }
    return _with(" UNION ALL ".join(f"SELECT '{n}' AS statistic, {_r6(e)} AS value FROM predictions" for n, e in parts.items()), "predictions")


def _kpi_sql() -> str:
    p, r, f = _quality_sql("tp", "fp", "fn")
    high = "risk_category = 'High'"
    auc = "SELECT sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)) FROM ranked"
    ap = "SELECT sum(pos * (cp / (cp + cn))) / sum(pos) FROM ranked"
    rows = {
        "Total Flights": "SELECT count(*) FROM predictions",
        "Actual Delays": "SELECT sum(is_delayed) FROM predictions",
        "Actual Delay Rate": "SELECT sum(is_delayed) / count(*) FROM predictions",
        "Accuracy": "SELECT (tp + tn) / (tp + fp + tn + fn) FROM outcomes",
        "Precision": f"SELECT {p} FROM outcomes",
        "Recall": f"SELECT {r} FROM outcomes",
        "F1 Score": f"SELECT {f} FROM outcomes",
        "ROC-AUC": auc,
        "PR-AUC": ap,
        "High-Risk Flights": f"SELECT count(*) FROM predictions WHERE {high}",
        "High-Risk Delay Capture": f"SELECT sum(is_delayed) FILTER (WHERE {high}) / sum(is_delayed) FROM predictions",
    }
    return _with(" UNION ALL ".join(f"SELECT '{n}' AS metric, {_r6(f'CAST(({q}) AS DOUBLE)')} AS value" for n, q in rows.items()), "outcomes", "ranked")


def oracle_sql() -> dict[str, str]:
    status = f"{DAY}, op_unique_carrier, origin, dest, cancelled, diverted"
    clock = "crs_dep_time, crs_dep_time // 100 AS scheduled_dep_hour, crs_dep_time % 100 AS scheduled_dep_minute"
    bad = "crs_dep_time < 0 OR crs_dep_time > 2359 OR crs_dep_time % 100 > 59"
    bad_clean = "crs_dep_time_clean < 0 OR crs_dep_time_clean > 2359 OR scheduled_dep_minute > 59"
    bad_flags = "cancelled NOT IN (0, 1) OR diverted NOT IN (0, 1)"
    conflict = "cancelled = 1 AND diverted = 1"
    rules = {"invalid_time_raw": bad, "invalid_time_clean": bad_clean, "bad_distance": "distance <= 0", "bad_flags": bad_flags, "conflicting_flags": conflict}
    silver_columns = ", ".join(DAY if c == "fl_date" else c for c in SILVER_COLUMNS)
    key_columns = f"{DAY}, op_unique_carrier, route, scheduled_dep_hour, is_delayed"
    preview = f"{DAY}, op_unique_carrier, origin, dest, crs_dep_time, scheduled_dep_hour, scheduled_dep_minute, flight_status, arr_delay, is_delayed"
    gapped = MODEL_FEATURES_V2
    # The feature table rounds places on the circle; inputs are prepared before rounding.
    exact = {f"{n}_{f}": f"{f}(2 * pi() * {c} / {k})" for n, c, k in (("dep_hour", "scheduled_dep_hour", 24), ("month", "month", 12)) for f in ("sin", "cos")}
    value = {c: exact.get(c, c) for c in gapped}
    medians = ", ".join(f"(SELECT coalesce(quantile_cont({value[c]}, 0.5), 0) FROM v2 WHERE fl_date < DATE '{P.train_end}') AS m_{c}" for c in gapped)
    imputed = f"SELECT fl_date, route, {', '.join(f'coalesce({value[c]}, m_{c}) AS {c}' for c in gapped)} FROM v2, (SELECT {medians})"
    scales = ", ".join(f"avg({c}) AS a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s_{c}" for c in gapped)
    train = f"fl_date < DATE '{P.train_end}'"
    quality_p, quality_r, quality_f = _quality_sql("tp", "fp", "fn")
    validation = f"(SELECT CAST(count(*) FILTER (WHERE is_delayed = 0) AS DOUBLE) / count(is_delayed) AS accuracy FROM parts WHERE part = 'validation')"

    sql = {
        "trips": _with(f"SELECT {', '.join(DAY if c == 'fl_date' else c for c in SILVER_COLUMNS[:24])} FROM trips", "trips"),
        "table_shapes": _table_shapes(),
        "flight_status": _with(f"SELECT {status}, flight_status FROM silver", "silver"),
        "dep_time_decode": _with(f"SELECT {clock} FROM trips", "trips"),
        "dep_time_clean": _with("SELECT crs_dep_time, crs_dep_time_clean, scheduled_dep_hour, scheduled_dep_minute FROM silver", "silver"),
        "delay_label": _with(f"SELECT {DAY}, origin, dest, arr_delay, is_delayed FROM silver", "silver"),
        "route_key": _with("SELECT origin, dest, concat_ws('_', origin, dest) AS route FROM trips", "trips"),
        "departure_period": _with("SELECT crs_dep_time, scheduled_dep_hour, departure_period FROM silver", "silver"),
        "is_weekend": _with(f"SELECT {DAY}, day_of_week, is_weekend, CASE WHEN day_of_week IN (1, 7) THEN 1 ELSE 0 END AS is_day_1_or_7 FROM completed", "completed"),
        "cyclical": _with("SELECT scheduled_dep_hour, month, dep_hour_sin, dep_hour_cos, month_sin, month_cos FROM v1", "v1"),
        "context_keys": _with(
            f"SELECT {DAY}, {', '.join(f'{k} || chr(95) || {b} AS {n}_key' for n, (k, b, _) in CONTEXTS.items())} FROM completed", "completed"
        ),
        "event_time": _with(
            f"""SELECT {DAY}, scheduled_dep_hour, scheduled_dep_minute, scheduled_dep_hour * 60 + scheduled_dep_minute AS scheduled_dep_minutes,
            strftime(make_timestamp(year(fl_date), month(fl_date), day(fl_date), scheduled_dep_hour, scheduled_dep_minute, 0), '%Y-%m-%d %H:%M:%S') AS flight_datetime_order, flight_timestamp FROM completed""",
            "completed",
        ),
        "silver": _with(f"SELECT {silver_columns} FROM silver", "silver"),
        "completed": _with(f"SELECT {silver_columns} FROM completed", "completed"),
        "cancelled_sample": _with(f"SELECT {DAY}, op_unique_carrier, origin, dest, cancellation_code, diverted FROM (SELECT * FROM trips WHERE cancelled = 1 ORDER BY fl_date, op_unique_carrier, origin, dest, cancellation_code, diverted LIMIT 20)", "trips"),
        "invalid_time_raw": _with(f"SELECT {clock} FROM trips WHERE {bad}", "trips"),
        "invalid_time_clean": _with(f"SELECT crs_dep_time, scheduled_dep_hour, scheduled_dep_minute, crs_dep_time_clean FROM silver WHERE {bad_clean}", "silver"),
        "midnight_audit": _with("SELECT crs_dep_time, crs_dep_time_clean, scheduled_dep_hour, scheduled_dep_minute FROM silver WHERE crs_dep_time = 2400", "silver"),
        "bad_distance": _with("SELECT origin, dest, distance FROM trips WHERE distance <= 0", "trips"),
        "bad_flags": _with(f"SELECT cancelled, diverted FROM trips WHERE {bad_flags}", "trips"),
        "conflicting_flags": _with(f"SELECT {status} FROM trips WHERE {conflict}", "trips"),
        "violations": _with(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS n_rows FROM silver" for n, c in rules.items()), "silver"),
        "feature_preview": _with(
            f"""SELECT CAST(fl_date AS VARCHAR) AS fl_date, * EXCLUDE (fl_date) FROM (SELECT fl_date, route, {', '.join(f'historical_{n}_flights, historical_{n}_delay_rate' for n in KEYS)}, is_delayed
            FROM v1 WHERE fl_date >= DATE '{P.preview_from}' ORDER BY fl_date, route, {', '.join(f'historical_{n}_flights NULLS FIRST, historical_{n}_delay_rate NULLS FIRST' for n in KEYS)}, is_delayed NULLS FIRST LIMIT 30)""",
            "v1",
        ),
        "history_for_key": _with(
            f"""SELECT {DAY}, origin, scheduled_dep_hour, scheduled_dep_minute, is_delayed, historical_origin_hour_flights, historical_origin_hour_delay_rate,
            origin_hour_flights_last_7d, origin_hour_delay_rate_last_7d FROM origin_hours WHERE origin = 'NATION_12' AND scheduled_dep_hour = 12""",
            "origin_hours",
        ),
        "temporal_split": _with("SELECT part, count(*) AS flights, CAST(min(fl_date) AS VARCHAR) AS first_day, CAST(max(fl_date) AS VARCHAR) AS last_day FROM parts GROUP BY part", "parts"),
        "preview": _with(f"SELECT {preview} FROM (SELECT * FROM silver ORDER BY fl_date, op_unique_carrier, origin, dest, crs_dep_time, scheduled_dep_hour, scheduled_dep_minute, flight_status, arr_delay NULLS FIRST, is_delayed NULLS FIRST LIMIT 20)", "silver"),
        "top_delays": _with(
            f"SELECT {DAY}, op_unique_carrier, origin, dest, dep_delay, arr_delay, cancelled, diverted FROM (SELECT * FROM silver ORDER BY arr_delay DESC NULLS LAST, silver.fl_date, op_unique_carrier, origin, dest, dep_delay NULLS FIRST, cancelled, diverted LIMIT 20)",
            "silver",
        ),
        "null_counts": _with(f"SELECT {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {c}' for c in SILVER_COLUMNS[:24])} FROM trips", "trips"),
        "duplicate_groups": _with(
            "SELECT count(*) AS duplicate_groups FROM (SELECT *, count(*) AS copies FROM trips GROUP BY ALL HAVING count(*) > 1)", "trips"
        ),
        "summary_delay": _summary(["dep_delay", "arr_delay", "cancelled", "diverted"], "trips"),
        "summary_ops": _summary(["dep_delay", "arr_delay", "taxi_out", "taxi_in", "air_time", "distance"], "completed"),
        "value_counts_cancelled": _counts("cancelled"),
        "value_counts_diverted": _counts("diverted"),
        "value_counts_carrier": _counts("op_unique_carrier"),
        "value_counts_origin": _counts("origin", "LIMIT 20"),
        "value_counts_cancellation_code": _counts("cancellation_code"),
        "value_counts_status": _counts("flight_status"),
        "value_counts_period": _counts("departure_period"),
        "missing_by_status": _with(
            f"SELECT cancelled, diverted, count(*) AS flights, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS missing_{c}' for c in ('arr_delay', 'dep_delay', 'actual_elapsed_time', 'air_time'))} FROM trips GROUP BY ALL", "trips"
        ),
        "pct_status": _with(_share("flight_status", "silver"), "silver"),
        "pct_label": _with(_share("is_delayed", "completed"), "completed"),
        "pct_label_by_split": _with(_share("is_delayed", "parts", "part"), "parts"),
        "pct_history": _with(_share("has_route_history", "v1"), "v1"),
        "history_range": _with(" UNION ALL ".join(f"SELECT 'historical_{n}_flights' AS column_name, min(historical_{n}_flights) AS min, max(historical_{n}_flights) AS max FROM v1" for n in KEYS), "v1"),
        "unreliable_counts": _with(" UNION ALL ".join(f"SELECT 'reliable_{n}_delay_rate' AS column_name, count(*) AS total, count(*) FILTER (WHERE reliable_{n}_delay_rate IS NULL) AS unreliable FROM v1" for n in KEYS), "v1"),
        "weekend_distinct": _with(f"SELECT DISTINCT {DAY}, day_of_week, is_weekend FROM completed", "completed"),
        "feature_nulls": _with(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS n_infinite FROM v2" for c in MODEL_FEATURES_V2), "v2"),
        "probability_profile": _profile_sql(),
        "label_distribution": _with(
            " UNION ALL ".join(
                f"SELECT '{c}' AS field, label, flights, {_r2('flights / CAST(sum(flights) OVER () AS DOUBLE) * 100')} AS percentage FROM (SELECT CAST({c} AS VARCHAR) AS label, count(*) AS flights FROM predictions GROUP BY ALL)"
                for c in ("is_delayed", "predicted_delay", "risk_category")
            ),
            "predictions",
        ),
        "carrier_stats": _stats("op_unique_carrier", extra=f"{_r2('quantile_cont(arr_delay, 0.5)')} AS median_arr_delay,"),
        "airport_stats": _stats("origin, origin_city_name, origin_state_nm", "dep_delay", tail=f"HAVING count(*) >= {P.airport_min} ORDER BY delay_rate_pct DESC, origin, origin_city_name, origin_state_nm LIMIT 20"),
        "period_stats": _stats("departure_period"),
        "hour_stats": _stats("scheduled_dep_hour"),
        "route_stats": _stats("route", tail=f"HAVING count(*) >= {P.route_min} ORDER BY delay_rate_pct DESC, route LIMIT 20"),
        "delay_causes": _with(f"SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in DELAY_CAUSES)} FROM completed WHERE arr_delay >= 15", "completed"),
        "month_stats": _stats("month"),
        "distance_stats": _stats(
            "distance_bucket",
            source="(SELECT *, CASE WHEN distance < 500 THEN '<500' WHEN distance < 1000 THEN '500-999' WHEN distance < 1500 THEN '1000-1499' WHEN distance < 2500 THEN '1500-2499' ELSE '2500+' END AS distance_bucket FROM completed)",
        ),
        "event_history": """
            WITH events_x AS (SELECT event_id, user_id % 25 AS origin, CAST(hour(ts) AS INTEGER) AS scheduled_dep_hour, CASE WHEN value >= 70 THEN 1 ELSE 0 END AS is_delayed,
                date_diff('second', TIMESTAMP '1970-01-01', date_trunc('second', ts)) AS t FROM events)
            SELECT event_id, origin, scheduled_dep_hour, is_delayed, count(*) OVER a AS historical_origin_hour_flights, sum(is_delayed) OVER a / nullif(count(*) OVER a, 0) AS historical_origin_hour_delay_rate,
                count(*) OVER b AS origin_hour_flights_last_7d, sum(is_delayed) OVER b / nullif(count(*) OVER b, 0) AS origin_hour_delay_rate_last_7d
            FROM events_x WINDOW a AS (PARTITION BY origin, scheduled_dep_hour ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                b AS (PARTITION BY origin, scheduled_dep_hour ORDER BY t RANGE BETWEEN 604800 PRECEDING AND 1 PRECEDING)""",
        "has_history": _with(f"SELECT {key_columns}, {', '.join(f'has_{n}_history' for n in KEYS)} FROM v1", "v1"),
        "reliable_rates_v1": _with(f"SELECT {key_columns}, {', '.join(f'reliable_{n}_delay_rate' for n in KEYS)} FROM v1", "v1"),
        "reliable_rates_v2": _with(f"SELECT {key_columns}, {', '.join(f'reliable_{n}_delay_rate' for n in CONTEXTS)} FROM contexts", "contexts"),
        "features_v1": _with(f"SELECT {_features(False)} FROM v1", "v1"),
        "features_v2": _with(f"SELECT {_features(True)} FROM v2", "v2"),
        "hash_sample": _with(
            f"""SELECT {DAY}, op_unique_carrier, origin, dest, crs_dep_time, distance, is_delayed FROM completed
            WHERE CAST('0x' || substr(md5(concat_ws('|', CAST(fl_date AS VARCHAR), op_unique_carrier, origin, dest, CAST(crs_dep_time AS VARCHAR), CAST(distance AS VARCHAR))), 1, 8) AS BIGINT) % 1000 < 100""",
            "completed",
        ),
        "exact_sample": _with(
            f"""SELECT * FROM (SELECT {DAY}, op_unique_carrier, origin, dest, crs_dep_time, distance, is_delayed FROM parts WHERE part = 'train')
            ORDER BY md5(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ('fl_date', 'op_unique_carrier', 'origin', 'dest', 'crs_dep_time', 'distance', 'is_delayed'))})),
            fl_date, op_unique_carrier, origin, dest, crs_dep_time, distance, is_delayed LIMIT 4000""",
            "parts",
        ),
        "freq_encode": _with(
            f"SELECT {DAY}, part, {', '.join(CATEGORICAL)}, {', '.join(f'f_{c}.n AS {c}_frequency' for c in CATEGORICAL)} FROM parts "
            + " ".join(f"LEFT JOIN (SELECT {c} AS v, count(*) AS n FROM parts WHERE part = 'train' GROUP BY ALL) f_{c} ON f_{c}.v = parts.{c}" for c in CATEGORICAL),
            "parts",
        ),
        "median_impute": _with(f"SELECT {DAY}, route, {', '.join(f'{_r6(c)} AS {c}' for c in gapped)} FROM ({imputed})", "v2"),
        "imputed_nulls": " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_infinite" for c in gapped),
        "standard_scale": _with(
            f"SELECT {DAY}, route, {', '.join(f'{_r6(f'({c} - a_{c}) / s_{c}')} AS {c}' for c in gapped)} FROM ({imputed}), (SELECT {scales} FROM ({imputed}) WHERE {train})", "v2"
        ),
        "class_weights": _with("SELECT is_delayed, n, CAST(sum(n) OVER () AS DOUBLE) / count(*) OVER () / n AS weight FROM (SELECT is_delayed, count(*) AS n FROM parts WHERE part = 'train' AND is_delayed IS NOT NULL GROUP BY ALL)", "parts"),
        "scale_pos_weight": _with("SELECT n AS negatives, p AS positives, n / p AS scale_pos_weight FROM (SELECT count(*) FILTER (WHERE is_delayed = 0) AS n, count(*) FILTER (WHERE is_delayed = 1) AS p FROM parts WHERE part = 'train')", "parts"),
        "predictions": _with(f"SELECT {DAY}, * EXCLUDE (fl_date) FROM predictions", "predictions"),
        "predicted_label": _with(f"SELECT {DAY}, route, delay_probability, predicted_delay FROM predictions", "predictions"),
        "risk_category": _with(f"SELECT {DAY}, route, delay_probability, risk_category FROM predictions", "predictions"),
        "baseline_metrics": _with(f"SELECT accuracy, CAST(0 AS DOUBLE) AS precision, CAST(0 AS DOUBLE) AS recall, CAST(0 AS DOUBLE) AS f1 FROM {validation}", "parts"),
        "binary_metrics": _with(f"SELECT (tp + tn) / (tp + fp + tn + fn) AS accuracy, {quality_p} AS precision, {quality_r} AS recall, {quality_f} AS f1 FROM outcomes", "outcomes"),
        "roc_auc": _with(f"SELECT {_r6('sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg))')} AS roc_auc FROM ranked", "ranked"),
        "average_precision": _with(f"SELECT {_r6('sum(pos * (cp / (cp + cn))) / sum(pos)')} AS average_precision FROM ranked", "ranked"),
        "confusion_matrix": _with(" UNION ALL ".join(f"SELECT {y} AS actual, {p} AS predicted, CAST({n} AS BIGINT) AS n FROM outcomes" for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))), "outcomes"),
        "threshold_sweep": _sweep_sql(SWEEP_BOOSTED),
        "threshold_sweep_first": _sweep_sql(SWEEP_FOREST_V1),
        "threshold_sweep_final": _sweep_sql(SWEEP_FINAL),
        "classification_report": _report_sql(),
        "airline_risk": _risk("op_unique_carrier", predicted=True),
        "carrier_ranking": _with(
            f"""SELECT row_number() OVER (ORDER BY rate DESC, op_unique_carrier) AS delay_rate_rank, op_unique_carrier, total_flights, actual_delays, {_r2('rate * 100')} AS actual_delay_rate_pct,
            {_r2('risk * 100')} AS avg_risk_pct, {_r2('predicted * 100')} AS predicted_delay_rate_pct FROM (SELECT op_unique_carrier, count(*) AS total_flights, CAST(sum(is_delayed) AS BIGINT) AS actual_delays,
            avg(is_delayed) AS rate, avg(delay_probability) AS risk, avg(predicted_delay) AS predicted FROM predictions GROUP BY ALL HAVING count(*) >= {P.carrier_test_min})""",
            "predictions",
        ),
        "route_risk": _risk("route", f"HAVING count(*) >= {P.route_test_min} ORDER BY avg(is_delayed) DESC, route LIMIT 20"),
        "hour_risk": _risk("scheduled_dep_hour"),
        "risk_table": _risk("risk_category"),
        "daily_trend": _risk("predictions.fl_date", shown="CAST(predictions.fl_date AS VARCHAR) AS fl_date"),
        "high_risk_coverage": _with(
            f"""SELECT *, {_r2('high_risk_flights / total_flights * 100')} AS flight_share_pct, {_r2('high_risk_delays / total_delays * 100')} AS delay_share_pct FROM (SELECT count(*) AS total_flights, CAST(sum(is_delayed) AS BIGINT) AS total_delays,
            count(*) FILTER (WHERE risk_category = 'High') AS high_risk_flights, CAST(sum(is_delayed) FILTER (WHERE risk_category = 'High') AS BIGINT) AS high_risk_delays FROM predictions)""",
            "predictions",
        ),
        "error_types": _with(
            """SELECT CASE WHEN predicted_delay = 1 AND is_delayed = 1 THEN 'True Positive' WHEN predicted_delay = 1 AND is_delayed = 0 THEN 'False Positive'
            WHEN predicted_delay = 0 AND is_delayed = 0 THEN 'True Negative' ELSE 'False Negative' END AS prediction_type, count(*) AS flights FROM predictions GROUP BY ALL""",
            "predictions",
        ),
        "carrier_model_quality": _with(
            f"""SELECT op_unique_carrier, total_flights, actual_delays, predicted_delays, true_positives, false_positives, false_negatives, avg_risk, {_r2('actual_delays / total_flights * 100')} AS actual_delay_rate_pct,
            {_r2('true_positives / nullif(predicted_delays, 0) * 100')} AS precision_pct, {_r2('true_positives / nullif(actual_delays, 0) * 100')} AS recall_pct, avg_risk_pct
            FROM (SELECT op_unique_carrier, count(*) AS total_flights, CAST(sum(is_delayed) AS BIGINT) AS actual_delays, CAST(sum(predicted_delay) AS BIGINT) AS predicted_delays,
            count(*) FILTER (WHERE predicted_delay = 1 AND is_delayed = 1) AS true_positives, count(*) FILTER (WHERE predicted_delay = 1 AND is_delayed = 0) AS false_positives,
            count(*) FILTER (WHERE predicted_delay = 0 AND is_delayed = 1) AS false_negatives, {_r6('avg(delay_probability)')} AS avg_risk, {_r2('avg(delay_probability) * 100')} AS avg_risk_pct
            FROM predictions GROUP BY ALL HAVING count(*) >= {P.carrier_test_min})""",
            "predictions",
        ),
        "model_kpis": _kpi_sql(),
    }
    sql["odd_time_history"] = _odd_times_sql()
    sql["violations_odd"] = _changed_trips(
        sql["violations"],
        """CASE distance % 11 WHEN 0 THEN 0 WHEN 1 THEN -distance ELSE distance END AS distance,
        CASE distance % 17 WHEN 0 THEN 2 WHEN 1 THEN NULL WHEN 2 THEN 1 ELSE cancelled END AS cancelled,
        CASE distance % 17 WHEN 2 THEN 1 WHEN 3 THEN -1 ELSE diverted END AS diverted,
        CASE distance % 13 WHEN 0 THEN NULL WHEN 1 THEN -1 WHEN 2 THEN 2360 ELSE crs_dep_time END AS crs_dep_time""",
    )
    for name, key in KEYS.items():
        sql[f"daily_{name}"] = _with(f"SELECT CAST(completed.fl_date AS VARCHAR) AS fl_date, {key}, count(*) AS {name}_flights, CAST(sum(is_delayed) AS BIGINT) AS {name}_delayed FROM completed GROUP BY ALL", "completed")
        sql[f"hist_{name}"] = _with(f"SELECT {DAY}, {key}, is_delayed, historical_{name}_flights, historical_{name}_delay_rate FROM v1", "v1")
        sql[f"roll7_{name}"] = _with(f"SELECT {DAY}, {key}, is_delayed, {name}_flights_last_7d, {name}_delay_rate_last_7d FROM v1", "v1")
    for name, (key, _, week) in CONTEXTS.items():
        columns = f"{DAY}, {key}, scheduled_dep_hour, scheduled_dep_minute, day_of_week, is_delayed"
        sql[f"ctx_{name}"] = _with(f"SELECT {columns}, historical_{name}_flights, historical_{name}_delay_rate FROM contexts", "contexts")
        if week:
            sql[f"ctx7_{name}"] = _with(f"SELECT {columns}, {name}_flights_last_7d, {name}_delay_rate_last_7d FROM contexts", "contexts")
    return sql


def _odd_times_sql() -> str:
    """Histories over trips whose departure times are changed as in the query."""
    changed = "CASE distance % 13 WHEN 0 THEN NULL WHEN 1 THEN -1 WHEN 2 THEN 2360 ELSE crs_dep_time END"
    columns = [f"historical_{n}_flights, historical_{n}_delay_rate, {n}_flights_last_7d, {n}_delay_rate_last_7d" for n in KEYS]
    for n, (_, _, week) in CONTEXTS.items():
        counts = [f"historical_{n}_flights"] + ([f"{n}_flights_last_7d"] if week else [])
        rates = [f"historical_{n}_delay_rate"] + ([f"{n}_delay_rate_last_7d"] if week else [])
        columns += [f"CASE WHEN flight_timestamp IS NULL THEN 0 ELSE {c} END AS {c}" for c in counts]
        columns += [f"CASE WHEN flight_timestamp IS NOT NULL THEN {c} END AS {c}" for c in rates]
    sql = _with(f"SELECT {DAY}, route, crs_dep_time, {', '.join(columns)} FROM v2", "v2")
    return _changed_trips(sql, f"{changed} AS crs_dep_time")


def _changed_trips(sql: str, changed: str) -> str:
    """A query over silver, whose trips are changed first."""
    head = "AS MATERIALIZED ("
    changed_trips = f"trips {head}SELECT * REPLACE ({changed}) FROM plain), silver {head}"
    return sql.replace(f"trips {head}", f"plain {head}", 1).replace(f"silver {head}", changed_trips, 1)


def _features(second: bool) -> str:
    from ..contract import FEATURES_V1, FEATURES_V2

    return ", ".join(DAY if c == "fl_date" else c for c in (FEATURES_V2 if second else FEATURES_V1))
