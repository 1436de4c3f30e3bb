"""The registered queries as SQL for another engine.

The logic is written anew. Wordings, scales and column lists that both sides must
share are taken from the operators, so these checks do not cover them; tests with
written-out values do.

Each text is a statement over the given tables. ``_with`` prepends the common
table expressions a statement names.
"""

from __future__ import annotations

import re

from wattframe.functions import bands
from wattframe.functions.text import BLANKS
from wattframe.operators import qa
from wattframe.operators.documents import ANALYSIS_TEXT, OBSERVATION_TEXT
from wattframe.operators.features import FEATURE_NAMES
from wattframe.operators.retrieval import ANALYSIS_HIT, OBSERVATION_HIT, OTHER_HIT
from wattframe.sources.tables import FEATURE_SCAN_COLUMNS, FORECAST_INPUTS

_CALENDAR = ("hour_of_day", "day_of_week", "is_weekend", "is_peak_hour")


def _r(expression: str, digits: int = 8) -> str:
    return f"round_even({expression}, {digits}) + 0.0"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill(template: str, **slots: str) -> str:
    """Template to a SQL concatenation."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = [slots[p] if i % 2 else _quoted(p) for i, p in enumerate(pieces) if i % 2 or p]
    return "(" + " || ".join(parts) + ")"


def _upper(value: str, scale) -> str:
    whens = " ".join(f"WHEN {value} < {b} THEN {_quoted(w)}" for b, w in scale[:-1])
    return f"CASE {whens} WHEN {value} IS NOT NULL THEN {_quoted(scale[-1][1])} END"


def _hours(value: str, scale) -> str:
    whens = " ".join(
        f"WHEN {value} BETWEEN {a} AND {b} THEN {_quoted(w)}" for a, b, w in scale[:-1]
    )
    return f"CASE {whens} ELSE {_quoted(scale[-1][2])} END"


def _sign(value: str, margin: float, above: str, below: str, between: str) -> str:
    return (
        f"CASE WHEN {value} > {margin} THEN {_quoted(above)} "
        f"WHEN {value} < -{margin} THEN {_quoted(below)} ELSE {_quoted(between)} END"
    )


def _volatility(value: str) -> str:
    return (
        f"CASE WHEN {value} > {bands.VOLATILITY_HIGH} THEN 'high' "
        f"WHEN {value} > {bands.VOLATILITY_MODERATE} THEN 'moderate' ELSE 'low' END"
    )


def _money(value: str, digits: int = 2) -> str:
    return f"printf('%.{digits}f', {value})"


def _filled(source: str, order: str, columns: str) -> str:
    """Null prices of ``source`` filled by the latest price at or before their time."""
    return f"""
    SELECT {columns}, coalesce(s.price, f.known) AS price
    FROM {source} s
    LEFT JOIN (
        SELECT settlement_point, timestamp,
               last_value(known IGNORE NULLS) OVER (
                   PARTITION BY settlement_point ORDER BY timestamp
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known
        FROM (SELECT settlement_point, timestamp,
                     arg_max(price, {order}) FILTER (WHERE price IS NOT NULL) AS known
              FROM {source} GROUP BY 1, 2)) f
    ON s.settlement_point IS NOT DISTINCT FROM f.settlement_point
       AND s.timestamp = f.timestamp"""


def _bounded(cap: int) -> str:
    return _r(f"least(greatest(coalesce(price, (SELECT median(price) FROM filled_rows)), 0.0), {cap}.0)")


_DIRTY_PRICE = (
    "CASE WHEN event_id % 50 = 7 THEN NULL WHEN event_id % 50 = 13 THEN -value "
    "WHEN event_id % 50 = 21 THEN value * 100 ELSE value END"
)
_DIRTY_TIME = "CASE WHEN event_id % 97 <> 5 THEN ts END"
_FRAME = (
    "(PARTITION BY settlement_point ORDER BY timestamp ROWS BETWEEN {0} PRECEDING "
    "AND 1 PRECEDING)"
)

_CTES: dict[str, str] = {
    "market": """
    SELECT ts AS timestamp, false AS repeat_hour_flag, event_type AS settlement_point,
           value AS price, event_id AS row_id
    FROM events""",
    "dirty": f"""
    SELECT {_DIRTY_TIME} AS timestamp, false AS repeat_hour_flag,
           event_type AS settlement_point, {_DIRTY_PRICE} AS price, event_id AS row_id
    FROM events""",
    "hourly": """
    SELECT settlement_point, date_trunc('hour', timestamp) AS timestamp, avg(price) AS price
    FROM market GROUP BY 1, 2""",
    "spine": """
    SELECT settlement_point, timestamp, h.price
    FROM (SELECT settlement_point,
                 unnest(generate_series(min(timestamp), max(timestamp), INTERVAL 1 HOUR)) AS timestamp
          FROM hourly GROUP BY 1) t
    LEFT JOIN hourly h USING (settlement_point, timestamp)""",
    "series": """
    SELECT settlement_point, timestamp,
           coalesce(last_value(price IGNORE NULLS) OVER (
                        PARTITION BY settlement_point ORDER BY timestamp
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    first_value(price IGNORE NULLS) OVER (
                        PARTITION BY settlement_point ORDER BY timestamp
                        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price
    FROM spine""",
    "frames": f"""
    SELECT settlement_point, rn - 25 AS window_id, timestamp AS target_time, price AS target_price,
           min(timestamp) OVER w AS window_start_time, max(timestamp) OVER w AS window_end_time,
           list(price) OVER w AS prices, list(timestamp) OVER w AS times,
           avg(price) OVER w AS p_mean, stddev_pop(price) OVER w AS p_std,
           min(price) OVER w AS p_min, max(price) OVER w AS p_max,
           quantile_cont(price, 0.5) OVER w AS p_median,
           regr_slope(price, rn) OVER w AS p_slope,
           avg(price) OVER {_FRAME.format(12)} AS p_ma_12,
           avg(price) OVER {_FRAME.format(6)} AS p_ma_6,
           min(price) OVER {_FRAME.format(6)} AS p_low,
           max(price) OVER {_FRAME.format(6)} AS p_high,
           first_value(price) OVER w AS p_first,
           lag(price, 1) OVER o AS p_last, lag(price, 2) OVER o AS p_last_2,
           lag(price, 4) OVER o AS p_last_4, rn
    FROM (SELECT *, row_number() OVER (PARTITION BY settlement_point ORDER BY timestamp) AS rn
          FROM series)
    WINDOW w AS (PARTITION BY settlement_point ORDER BY timestamp
                 ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING),
           o AS (PARTITION BY settlement_point ORDER BY timestamp)""",
    "windows": "SELECT * FROM frames WHERE rn > 24",
    "features": f"""
    SELECT settlement_point, window_id::INTEGER AS window_id, target_time, target_price,
           {_r("p_mean")} AS price_mean,
           {_r("p_std")} AS price_std,
           {_r("p_min")} AS price_min,
           {_r("p_max")} AS price_max,
           {_r("p_median")} AS price_median,
           {_r("p_slope")} AS trend_slope,
           {_r("p_last - p_first")} AS price_change,
           {_r("CASE WHEN p_first <> 0 THEN (p_last - p_first) * 100 / p_first ELSE 0 END")}
               AS price_change_pct,
           {_r("p_max - p_min")} AS price_range,
           {_r("CASE WHEN p_mean <> 0 THEN p_std / p_mean ELSE 0 END")} AS price_volatility,
           {_r("p_ma_12")} AS price_ma_12,
           {_r("p_ma_6")} AS price_ma_6,
           hour(target_time)::INTEGER AS hour_of_day,
           (isodow(target_time) - 1)::INTEGER AS day_of_week,
           (isodow(target_time) >= 6)::INTEGER AS is_weekend,
           (hour(target_time) BETWEEN 14 AND 18)::INTEGER AS is_peak_hour,
           {_r("p_last - p_last_2")} AS momentum_1h,
           {_r("p_last - p_last_4")} AS momentum_3h,
           {_r("CASE WHEN p_high <> p_low THEN (p_last - p_low) / (p_high - p_low) ELSE 0.5 END")}
               AS relative_position,
           prices
    FROM windows""",
    "features_dirty": """
    SELECT * REPLACE (
        CASE WHEN window_id % 7 <> 3 THEN price_std END AS price_std,
        CASE WHEN window_id % 11 <> 0 THEN momentum_1h END AS momentum_1h,
        CASE WHEN window_id % 13 = 5 THEN 'infinity'::DOUBLE ELSE price_volatility END
            AS price_volatility)
    FROM features""",
    "predictions": """
    SELECT settlement_point, window_id, target_time, target_price AS actual,
           price_ma_6 AS predicted
    FROM features""",
    "recent": "SELECT * FROM market",
    "baseline": """
    SELECT CASE WHEN count(*) = 0 THEN 35.0 ELSE avg(price) END AS baseline_price,
           CASE WHEN count(*) = 0 THEN 10.0 ELSE stddev_samp(price) END AS price_std
    FROM recent""",
    "split": """
    SELECT settlement_point, window_id,
           row_number() OVER (ORDER BY k) <= ceil(0.2 * count(*) OVER ()) AS is_test, k
    FROM (SELECT settlement_point, window_id,
                 md5(settlement_point || '|' || window_id || '|42') AS k FROM features)""",
    "docs_observation": f"""
    SELECT 'market_' || settlement_point || '_' || strftime(timestamp, '%Y%m%d_%H%M') AS doc_id,
           {_fill(
               OBSERVATION_TEXT,
               point="settlement_point",
               day="dayname(timestamp)",
               time="strftime(timestamp, '%Y-%m-%d %H:%M')",
               price=_money("price"),
               price_level=_upper("price", bands.DOCUMENT_PRICE_BANDS),
               time_period=_hours("hour(timestamp)", bands.DOCUMENT_HOUR_BANDS),
           )} AS text,
           'market_observation' AS type,
           strftime(timestamp, '%Y-%m-%d %H:%M') AS timestamp,
           settlement_point, price,
           hour(timestamp)::INTEGER AS hour,
           (isodow(timestamp) - 1)::INTEGER AS day_of_week,
           {_upper("price", bands.DOCUMENT_PRICE_BANDS)} AS price_level,
           {_hours("hour(timestamp)", bands.DOCUMENT_HOUR_BANDS)} AS time_period,
           row_id
    FROM market""",
    "docs_analysis": f"""
    SELECT 'analysis_' || window_id || '_' || strftime(target_time, '%Y%m%d_%H%M') AS doc_id,
           {_fill(
               ANALYSIS_TEXT,
               time="strftime(target_time, '%Y-%m-%d %H:%M')",
               trend=_sign("trend_slope", 0.0, "increasing", "decreasing", "stable"),
               volatility=f"{_volatility('price_volatility')} || ' volatility'",
               mean=_money("price_mean"),
               std=_money("price_std"),
               momentum=_sign(
                   "momentum_1h", 1.0, "upward momentum", "downward momentum", "stable momentum"
               ),
               low=_money("list_min(prices)"),
               high=_money("list_max(prices)"),
               period="CASE WHEN is_weekend = 1 THEN 'weekend' ELSE 'weekday' END",
               peak="CASE WHEN is_peak_hour = 1 THEN 'peak demand period' "
               "ELSE 'off-peak period' END",
               target=_money("target_price"),
           )} AS text,
           'market_analysis' AS type,
           strftime(target_time, '%Y-%m-%d %H:%M') AS timestamp,
           {_r("target_price")} AS target_price,
           price_mean, price_std, trend_slope, price_volatility, hour_of_day,
           is_weekend = 1 AS is_weekend, is_peak_hour = 1 AS is_peak_hour, momentum_1h,
           {_r("list_max(prices) - list_min(prices)")} AS price_range,
           {_sign("trend_slope", 0.0, "increasing", "decreasing", "stable")} AS trend_direction,
           {_volatility("price_volatility")} || ' volatility' AS volatility_level
    FROM features""",
    "centroids": """
    SELECT label AS query_id, list(x ORDER BY pos) AS q
    FROM (SELECT label, pos, avg(x) AS x
          FROM (SELECT label, unnest(embedding)::DOUBLE AS x,
                       generate_subscripts(embedding, 1) AS pos FROM embeddings)
          GROUP BY 1, 2)
    GROUP BY 1""",
    "hits": """
    SELECT query_id, doc_id, similarity, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id)::INTEGER
                  AS rank
        FROM (SELECT query_id, vec_id AS doc_id,
                     round(list_cosine_similarity(embedding::DOUBLE[], q), 12) AS similarity
              FROM embeddings, centroids))
    WHERE rank <= 5""",
    "metadata": """
    SELECT e.vec_id AS doc_id,
           CASE WHEN label < 5 THEN 'market_observation' WHEN label < 8 THEN 'market_analysis'
                WHEN label < 9 THEN 'note' END AS type,
           strftime(m.timestamp, '%Y-%m-%d %H:%M') AS timestamp,
           CASE WHEN label % 2 = 0 THEN m.settlement_point END AS settlement_point,
           CASE WHEN label <> 3 THEN m.price END AS price,
           CASE WHEN label <> 6 THEN m.price END AS target_price,
           CASE WHEN m.price < 20 THEN 'low price' END AS price_level,
           CASE WHEN m.price > 20 THEN 'increasing' END AS trend_direction
    FROM embeddings e LEFT JOIN market m ON m.row_id = e.vec_id""",
    "rendered": f"""
    SELECT query_id, rank, doc_id, similarity, type,
           CASE type
             WHEN 'market_observation' THEN {_fill(
                 OBSERVATION_HIT,
                 point="coalesce(settlement_point, 'unknown location')",
                 time="coalesce(timestamp, 'unknown time')",
                 price=_money("coalesce(price, 0.0)"),
                 level="coalesce(price_level, 'unknown level')",
                 period="'unknown period'",
             )}
             WHEN 'market_analysis' THEN {_fill(
                 ANALYSIS_HIT,
                 time="coalesce(timestamp, 'unknown time')",
                 target=_money("coalesce(target_price, 0.0)"),
                 trend="coalesce(trend_direction, 'stable')",
                 volatility="'moderate'",
             )}
             ELSE {_fill(OTHER_HIT, doc_id="doc_id::VARCHAR", type="type")} END AS doc_text
    FROM (SELECT hits.*, metadata.* EXCLUDE (doc_id, type),
                 coalesce(metadata.type, 'unknown') AS type
          FROM hits LEFT JOIN metadata USING (doc_id))""",
    "near_any": """
    SELECT * FROM (
        SELECT m.row_id, m.timestamp, f.target_time AS feature_target_time,
               f.settlement_point AS feature_settlement_point,
               f.window_id AS feature_window_id, f.target_price AS feature_target_price,
               f.trend_slope AS feature_trend_slope,
               f.price_volatility AS feature_price_volatility,
               f.momentum_1h AS feature_momentum_1h,
               row_number() OVER (PARTITION BY m.row_id
                                  ORDER BY f.target_time DESC NULLS LAST, f.settlement_point) AS n
        FROM market m LEFT JOIN features f
          ON f.target_time > m.timestamp - INTERVAL 1 HOUR
         AND f.target_time < m.timestamp + INTERVAL 1 HOUR)
    WHERE n = 1""",
    "near": """
    SELECT * FROM (
        SELECT m.*, f.target_time AS feature_target_time, f.window_id AS feature_window_id,
               f.trend_slope AS feature_trend_slope,
               f.price_volatility AS feature_price_volatility,
               f.momentum_1h AS feature_momentum_1h,
               row_number() OVER (PARTITION BY m.row_id
                                  ORDER BY f.target_time DESC NULLS LAST) AS n
        FROM market m LEFT JOIN features f
          ON f.settlement_point = m.settlement_point
         AND f.target_time > m.timestamp - INTERVAL 1 HOUR
         AND f.target_time < m.timestamp + INTERVAL 1 HOUR)
    WHERE n = 1""",
    "asked": """
    SELECT row_id,
           CASE row_id % 9 WHEN 0 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
                WHEN 1 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ')
                WHEN 2 THEN strftime(timestamp, '%Y-%m-%d %H:%M:%S')
                WHEN 3 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f')
                WHEN 4 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S+02:00')
                WHEN 5 THEN strftime(timestamp, '%Y-%m-%dT%H')
                WHEN 6 THEN strftime(timestamp, '%Y%m%dT%H%M%S')
                WHEN 7 THEN strftime(timestamp, '%Y-%m-%dT%H:%M')
                ELSE 'nope' END AS requested,
           CASE row_id % 9 WHEN 3 THEN timestamp
                WHEN 5 THEN date_trunc('hour', timestamp)
                WHEN 7 THEN date_trunc('minute', timestamp)
                WHEN 8 THEN NULL
                ELSE date_trunc('second', timestamp) END AS target_time
    FROM market""",
    "term_slots": r"""
    SELECT doc_id, ('0x' || substr(md5(word), 1, 8))::BIGINT % 384 AS slot, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word
          FROM documents)
    GROUP BY 1, 2""",
    "slot_weights": """
    SELECT slot, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) AS weight
    FROM term_slots GROUP BY 1""",
    "term_vectors": """
    SELECT doc_id, slot, n * weight / nullif(sqrt(sum(n * weight * n * weight) OVER (PARTITION BY doc_id)), 0)
               AS x
    FROM term_slots JOIN slot_weights USING (slot)""",
    "encoded": """
    SELECT doc_id, max(length(text)) OVER (PARTITION BY doc_id // 32) > 15000 AS failed,
           printf('%d.0,%d.0,%d.0', length(text), len(string_split(text, ' ')),
                  length(text) - length(replace(text, chr(10), '')) + 1) AS vector
    FROM documents""",
    "scored": """
    SELECT event_type AS run,
           'How was ' || event_type || ' at ' || strftime(ts, '%H') || '?' AS question,
           avg(value) AS base, stddev_pop(value) AS tuned
    FROM events GROUP BY 1, 2""",
}

def _around_clock_changes(time: str) -> str:
    moved = "TIMESTAMP '{}' + to_seconds(event_id // 40 % 14400)"
    return f"""CASE WHEN {time} IS NULL THEN NULL WHEN event_id % 40 = 4 THEN {moved.format("2024-11-03")}
                    WHEN event_id % 40 = 5 THEN {moved.format("2024-03-10")} ELSE {time} END"""


def _in_utc(local: str, winter: int, again: str = "event_id % 3 = 0") -> str:
    """UTC of a local time in a zone that changes its clocks as New York does, by hours behind UTC in winter."""
    back = f"CASE WHEN {again} THEN TIMESTAMP '2024-11-03 01:00' ELSE TIMESTAMP '2024-11-03 02:00' END"
    return f"""{local} + to_hours(CASE WHEN {local} >= TIMESTAMP '2024-03-10 03:00' AND {local} < {back}
                                  THEN {winter - 1} ELSE {winter} END)"""


_FEED_PRICE = f"CASE WHEN event_id % 50 = 7 THEN NULL ELSE {_DIRTY_PRICE} END"
_CTES |= {
    "pjm_rows": f"""
    SELECT {_in_utc("local", 5)} AS timestamp, event_id % 3 = 0 AS repeat_hour_flag,
           CASE WHEN event_id % 31 <> 3 THEN event_type ELSE 'PJM_UNKNOWN' END
               AS settlement_point,
           {_FEED_PRICE} AS price, 'PJM' AS iso, 'ZONE' AS location_type
    FROM (SELECT *, date_trunc('second', {_around_clock_changes(_DIRTY_TIME)}) AS local FROM events)
    WHERE local IS NOT NULL""",
    "miso_rows": """
    SELECT date_trunc('second', ts)
               + CASE WHEN event_id % 3 = 2 THEN INTERVAL 0 HOUR ELSE INTERVAL 6 HOUR END
               AS timestamp, false AS repeat_hour_flag,
           event_type AS settlement_point,
           CASE WHEN event_id % 50 <> 7 THEN value END AS price,
           'MISO' AS iso, 'LMP' AS location_type
    FROM events WHERE event_id % 101 <> 1""",
    "split_rows": """
    SELECT date_trunc('minute', ts) + INTERVAL 6 HOUR AS timestamp, false AS repeat_hour_flag,
           event_type AS settlement_point,
           CASE WHEN event_id % 50 <> 7 THEN value END AS price,
           'MISO' AS iso, 'PNODE' AS location_type
    FROM events""",
    "timed": "SELECT * FROM dirty WHERE timestamp IS NOT NULL",
}


def _with(statement: str, **extra: str) -> str:
    """Statement with the common table expressions it needs, in order of definition."""
    defined = {**_CTES, **extra}
    needed: list[str] = []

    def need(text: str, own: str | None) -> None:
        for name, body in defined.items():
            if name != own and name not in needed and re.search(rf"\b{name}\b", text):
                if re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                    need(body, name)
                    if name not in needed:
                        needed.append(name)

    need(statement, None)
    if not needed:
        return statement
    return "WITH " + ",\n".join(f"{n} AS ({defined[n]})" for n in needed) + "\n" + statement


def _feed(rows: str, cap: int = 5000) -> str:
    """A feed after cleaning, in the common schema."""
    columns = "s.timestamp, s.repeat_hour_flag, s.settlement_point, s.iso, s.location_type"
    filled = _filled(rows, "price", columns)
    return f"""
    SELECT timestamp, repeat_hour_flag, settlement_point,
           {_bounded(cap).replace("filled_rows", f"({filled})")} AS price, iso, location_type,
           settlement_point AS location_id
    FROM ({filled})"""


_CLEAN_COLUMNS = "s.timestamp, s.repeat_hour_flag, s.settlement_point, s.row_id"
_CLEAN_FILLED = _filled("timed", "row_id", _CLEAN_COLUMNS)
_CLEAN = f"""
    SELECT timestamp, repeat_hour_flag, settlement_point,
           {_bounded(1000).replace("filled_rows", f"({_CLEAN_FILLED})")} AS price, row_id
    FROM ({_CLEAN_FILLED})"""

_CLOCK = "strftime({0}, '%H:%M') || ' on ' || dayname({0})"
_SEQUENCE = "list_aggregate(list_transform({0}, lambda x: printf('%.6f', x)), 'string_agg', ',')"


def _question(kind: str, key: str, slots: dict[str, str]) -> str:
    wordings = [_fill(w, **slots) for w in qa.QUESTIONS[kind]]
    if len(wordings) == 1:
        return wordings[0]
    # Four hex digits as a number modulo four: the last digit decides.
    place = f"(strpos('0123456789abcdef', substr({key}, 12, 1)) - 1) % {len(wordings)} + 1"
    return f"[{', '.join(wordings)}][{place}]"


_PAIR_SLOTS = {
    "time": _CLOCK.format("timestamp"),
    "price": _money("price"),
    "point": "settlement_point",
    "level": _upper("price", bands.PAIR_PRICE_LEVELS),
    "condition": _upper("price", bands.PAIR_PRICE_CONDITIONS),
    "factor": _hours("hour(timestamp)", bands.PAIR_HOUR_FACTORS),
    "load": _hours("hour(timestamp)", bands.LOAD_BY_HOUR),
    "stress": _hours("hour(timestamp)", bands.STRESS_BY_HOUR),
    "trend": _sign("feature_trend_slope", 0.0, "increasing", "decreasing", "stable"),
    "volatility": f"{_volatility('feature_price_volatility')} || ' volatility'",
    "pressure": _sign(
        "feature_momentum_1h", 1.0, "upward pressure", "downward pressure", "stable conditions"
    ),
}
_TECHNICAL_SLOTS = {
    "time": _CLOCK.format("target_time"),
    "stance": _sign("trend_slope", 0.1, "bullish", "bearish", "neutral"),
    "volatility": _volatility("price_volatility"),
    "mean": _money("price_mean"),
    "target": _money("target_price"),
    "slope": _money("trend_slope", 3),
}


def _dispatch(part: int) -> str:
    yes, maybe, no = (
        _fill(c[part], price=_money("price"))
        for c in (qa.DISPATCH_YES, qa.DISPATCH_MAYBE, qa.DISPATCH_NO)
    )
    return (
        f"CASE WHEN price > {qa.DISPATCH_ABOVE} THEN {yes} "
        f"WHEN price > {qa.CONSIDER_ABOVE} THEN {maybe} ELSE {no} END"
    )


_MATCHED = "feature_target_time IS NOT NULL"
_ANSWERS = {
    qa.FORECAST: f"CASE WHEN {_MATCHED} THEN {_fill(qa.FORECAST_MATCHED, **_PAIR_SLOTS)} "
    f"ELSE {_fill(qa.FORECAST_ALONE, **_PAIR_SLOTS)} END",
    qa.DISPATCH: _fill(
        qa.DISPATCH_ANSWER, **_PAIR_SLOTS, recommendation=_dispatch(0), reason=_dispatch(1)
    ),
    qa.MARKET: f"CASE WHEN {_MATCHED} THEN {_fill(qa.MARKET_MATCHED, **_PAIR_SLOTS)} "
    f"ELSE {_fill(qa.MARKET_ALONE, **_PAIR_SLOTS)} END",
    qa.OPERATIONAL: _fill(qa.OPERATIONAL_ANSWER, **_PAIR_SLOTS),
    qa.TECHNICAL: _fill(qa.TECHNICAL_ANSWER, **_TECHNICAL_SLOTS),
}


def _pair(kind: str) -> str:
    """All pairs of a type, with their key."""
    if kind == qa.TECHNICAL:
        source, ids, slots = "features", ("settlement_point", "window_id"), _TECHNICAL_SLOTS
    else:
        source = "near" if kind in (qa.FORECAST, qa.MARKET) else "market"
        ids, slots = ("row_id",), _PAIR_SLOTS
    key = f"md5('{kind}|' || {' || chr(124) || '.join(ids)} || '|42')"
    shown = ", ".join(f"{i}::VARCHAR AS {i}" for i in ids)
    return f"""
    SELECT {shown}, {_question(kind, "pair_key", slots)} AS question,
           {_ANSWERS[kind]} AS answer, '{kind}' AS type, pair_key
    FROM (SELECT *, {key} AS pair_key FROM {source})"""


def _sampled(shares: dict[str, float]) -> str:
    parts = []
    for kind, share in shares.items():
        bound = f"{int(share * 16**8):08x}" if share < 1 else "g"
        parts.append(
            f"SELECT question, answer, type, pair_key FROM ({_pair(kind)}) "
            f"WHERE substr(pair_key, 1, 8) < '{bound}'"
        )
    return "\nUNION ALL\n".join(parts)


def _listed(names) -> str:
    return ", ".join(names)


_FEATURE_LIST = _listed(
    ["settlement_point", "window_id", "target_time", _r("target_price") + " AS target_price"]
    + list(FEATURE_NAMES)
)
_FILL_FEATURES = _listed(
    f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY settlement_point "
    f"ORDER BY target_time DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}"
    for c in FORECAST_INPUTS
)
_TRIMMED = "list_transform(string_split(answer, '.'), lambda x: trim(x, " + (
    "chr("
    + ") || chr(".join(str(ord(c)) for c in BLANKS)
    + ")))"
)


def _standard(c: str) -> str:
    m = f"avg({c}) FILTER (WHERE NOT is_test) OVER ()"
    s = f"stddev_pop({c}) FILTER (WHERE NOT is_test) OVER ()"
    return f"{_r(f'({c} - {m}) / CASE WHEN {s} = 0 THEN 1 ELSE {s} END')} AS {c}"


def _errors(name: str, error: str) -> str:
    return f"sqrt(avg(({error}) * ({error}))) AS {name}_rmse, avg(abs({error})) AS {name}_mae"


_BY_RULE = f"""SELECT row_id, requested, target_time,
           CASE WHEN target_time IS NOT NULL THEN
           {_r('''least(greatest((SELECT baseline_price FROM baseline) *
               CASE WHEN hour(target_time) BETWEEN 14 AND 18 THEN 1.4
                    WHEN hour(target_time) <= 6 THEN 0.7
                    WHEN isodow(target_time) >= 6 THEN 0.9 ELSE 1.0 END, 15.0), 100.0)''', 2)}
           END AS predicted_price,
           CASE WHEN target_time IS NOT NULL THEN 0.65::DOUBLE END AS confidence,
           CASE WHEN target_time IS NOT NULL THEN 'Baseline' END AS model_type,
           CASE WHEN target_time IS NULL THEN 'Invalid timestamp format' END AS error
    FROM asked"""

def _given_forest() -> str:
    """A walk from the root to a leaf of each tree made by rule, for every window."""
    inputs = (
        "price_mean", "price_std", "trend_slope", "price_volatility", "hour_of_day", "day_of_week", "is_weekend",
        "is_peak_hour", "momentum_1h",
    )
    given = ", ".join(f"CAST({c} AS DOUBLE)" for c in inputs)
    source = f"(SELECT *, 0 AS n0 FROM (SELECT settlement_point, window_id, [{given}] AS given FROM features), range(7) t(tree))"
    for step in range(4):
        node = f"n{step}"
        test = f"(given[(tree * 5 + {node} * 7) % 9 + 1] - 10.0) / 4.0 <= (tree * 11 + {node} * 3) % 17 / 2.0 - 4.0"
        source = f"(SELECT *, 2 * {node} + CASE WHEN {test} THEN 1 ELSE 2 END AS n{step + 1} FROM {source})"
    price = _r("least(greatest(sum((tree * 17 + n4 * 29) % 90 + 10.0)::DOUBLE / 7, 15), 100)", 2)
    return f"SELECT settlement_point, window_id, {price} AS predicted_price FROM {source} GROUP BY ALL"


# The split of least squared error among those by the hour, the weekday and their flags.
_BEST_SPLIT = {
    "calendar": """
    SELECT target_price, unnest([1, 2, 3, 4]) AS input, unnest([hour_of_day, day_of_week, is_weekend, is_peak_hour]) AS value
    FROM features""",
    "cuts": """
    SELECT input, value AS cut, lead(value) OVER (PARTITION BY input ORDER BY value) AS following
    FROM (SELECT DISTINCT input, value FROM calendar)""",
    "best_split": """
    SELECT input, cut, avg(target_price) FILTER (value <= cut) AS low, avg(target_price) FILTER (value > cut) AS high
    FROM calendar JOIN cuts USING (input) WHERE following IS NOT NULL GROUP BY ALL
    ORDER BY count(*) FILTER (value <= cut) * var_pop(target_price) FILTER (value <= cut)
             + count(*) FILTER (value > cut) * var_pop(target_price) FILTER (value > cut), input, cut
    LIMIT 1""",
}

CHECKS: dict[str, str] = {
    # Sources and sinks
    "ingest_positional": _with(
        """SELECT timestamp, repeat_hour_flag, settlement_point,
                  CASE WHEN row_id % 50 <> 7 THEN price END AS price FROM market"""
    ),
    "ingest_envelope": _with(
        """SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS datetime_beginning_ept,
                  settlement_point AS pnode_id, price AS total_lmp, 'ZONE' AS type FROM market"""
    ),
    "ingest_bad_payloads": """
        SELECT DISTINCT event_id // 100 + 1000000 AS block FROM events
        WHERE (event_id // 100) % 7 = 3""",
    "ingest_variants": """
        SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, event_type AS point, value AS price,
               CASE WHEN event_id // 7 % 3 < 2 THEN 'ZONE' END AS kind, NULL::VARCHAR AS zone
        FROM events""",
    "payload_members": """
        SELECT member, count(n) AS n_records, bool_or(known) AS known
        FROM (
            SELECT unnest([['datetime_beginning_ept', 'pnode_id', 'total_lmp', 'type'], ['datetime_beginning_ept', 'node', 'lmp'],
                           ['DateTime', 'pnode_id', 'LMP', 'rev']][event_id // 7 % 3 + 1]) AS member, 1 AS n, false AS known
            FROM events
            UNION ALL
            SELECT unnest(['datetime_beginning_ept', 'DateTime', 'pnode_id', 'node', 'total_lmp', 'lmp', 'LMP', 'type', 'zone']), NULL, true
        ) GROUP BY 1""",
    "ingest_json": _with(
        """SELECT strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS datetime_beginning_ept,
                  settlement_point AS pnode_id, price AS total_lmp, 'ZONE' AS type FROM market"""
    ),
    "ingest_positional_files": _with(
        """SELECT timestamp, repeat_hour_flag, settlement_point,
                  CASE WHEN row_id % 50 <> 7 THEN price END AS price FROM market"""
    ),
    "ingest_csv": _with(
        """SELECT CASE WHEN row_id % 101 = 1 THEN 'soon'
                       WHEN row_id % 3 = 0 THEN strftime(timestamp, '%Y-%m-%d %H:%M:%S')
                       WHEN row_id % 3 = 1 THEN strftime(timestamp, '%-m/%-d/%Y %-H:%M:%S')
                       ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%SZ') END AS LocalTime,
                  settlement_point AS Pnode,
                  CASE WHEN row_id % 50 = 7 THEN 'n/a' ELSE price::VARCHAR END AS LMP,
                  'LMP' AS PriceType
           FROM market"""
    ),
    "scan_sorted": _with(
        "SELECT timestamp, settlement_point, price FROM market ORDER BY 1, 2"
    ),
    "scan_days_back": _with(
        """SELECT timestamp, repeat_hour_flag, settlement_point, price FROM market
           WHERE timestamp >= (SELECT max(timestamp) FROM market) - INTERVAL 7 DAY"""
    ),
    "scan_stored_days": _with(
        """SELECT 'ERCOT' AS iso, timestamp, settlement_point, price, row_id FROM market
           WHERE timestamp >= (SELECT max(timestamp) FROM market) - INTERVAL 7 DAY"""
    ),
    "scan_feature_matrix": _with(
        f"""SELECT {_listed(c for c in FEATURE_SCAN_COLUMNS if c != "target_price")},
                   {_r("target_price")} AS target_price, settlement_point FROM features"""
    ),
    "scan_latest_n": _with("SELECT * FROM market ORDER BY timestamp DESC, row_id LIMIT 500"),
    "scan_features": _with(
        f"SELECT {_listed(FEATURE_SCAN_COLUMNS)}, settlement_point FROM features"
    ),
    "vectors_from_map": f"""
        SELECT 'v' || vec_id AS doc_id, len(embedding)::INTEGER AS dimension,
               {_SEQUENCE.format("embedding::DOUBLE[]")} AS vector, label::VARCHAR AS label
        FROM embeddings""",
    "read_eval_report": _with(
        f"""SELECT run, avg(tuned) OVER (PARTITION BY run) < avg(base) OVER (PARTITION BY run)
                       AS test_passed,
                   question, {_r("base")} AS base_perplexity,
                   {_r("tuned")} AS fine_tuned_perplexity,
                   {_r("base - tuned")} AS improvement, tuned < base AS improved
            FROM scored"""
    ),
    "sink_replace": _with("SELECT * FROM market"),
    "sink_append": """SELECT count(*) AS rows_before, 2 * count(*) AS total_rows,
                             count(*) AS rows_added FROM events""",
    "sink_audit": """SELECT count(*) AS frame_rows, count(*) AS stored_rows, true AS rows_match
                     FROM events""",
    "sink_vectors": """SELECT count(*) AS vector_count, max(len(embedding))::INTEGER AS dimension,
                              'cosine' AS metric, 'given' AS embedding_model FROM embeddings""",
    # Projection, filters, cleaning
    "normalize_pjm": _with(_feed("pjm_rows")),
    "normalize_miso": _with(_feed("miso_rows")),
    "normalize_miso_split": _with(_feed("split_rows")),
    "union_feeds": _with(_feed("pjm_rows") + "\nUNION ALL\n" + _feed("split_rows")),
    "to_utc": f"""
        SELECT event_id AS row_id, {_in_utc("local", 5)} AS from_new_york, {_in_utc("local", 6)} AS from_chicago,
               {_in_utc("local", 6, "false")} AS first_pass
        FROM (SELECT *, {_around_clock_changes("ts")} AS local FROM events)""",
    "to_utc_by_zone": f"""
        SELECT event_id AS row_id, ['America/New_York', 'America/Chicago', 'Mars/Base'][event_id % 3 + 1] AS zone,
               CASE event_id % 3 WHEN 0 THEN {_in_utc("local", 5)} WHEN 1 THEN {_in_utc("local", 6)} END AS utc
        FROM (SELECT *, {_around_clock_changes("ts")} AS local FROM events)""",
    "coerce_price": """
        SELECT event_type AS Pnode, CASE WHEN event_id % 50 <> 7 THEN value END AS price,
               CASE WHEN event_id % 50 = 7 THEN 'n/a' ELSE value::VARCHAR END AS raw_price
        FROM events""",
    "ffill_price": _with(_CLEAN_FILLED),
    "impute_median": _with(
        f"""SELECT timestamp, repeat_hour_flag, settlement_point,
                   {_r("coalesce(price, (SELECT median(price) FROM dirty))")} AS price, row_id
            FROM dirty"""
    ),
    "clamp_price": _with(
        """SELECT timestamp, repeat_hour_flag, settlement_point,
                  CASE WHEN price < 0 THEN 0.0 WHEN price > 1000 THEN 1000.0 ELSE price END
                      AS price, row_id
           FROM dirty"""
    ),
    "clean_prices": _with(_CLEAN),
    "quality_report": _with(
        f"""SELECT count(*) AS rows_before,
                   count(*) FILTER (WHERE timestamp IS NULL) AS null_timestamps,
                   count(*) FILTER (WHERE price IS NULL) AS null_prices,
                   count(*) FILTER (WHERE price < 0) AS negative_prices,
                   count(*) FILTER (WHERE price > 1000) AS extreme_prices,
                   count(timestamp) AS rows_after,
                   count(*) - count(timestamp) AS rows_lost,
                   {_r("(count(*) - count(timestamp)) * 100.0 / count(*)")} AS lost_pct
            FROM dirty"""
    ),
    "features_fill": _with(
        f"""SELECT settlement_point, window_id, target_time, target_price, {_FILL_FEATURES}
            FROM features_dirty"""
    ),
    "features_finite": _with(
        f"""SELECT settlement_point, {_listed(FEATURE_SCAN_COLUMNS)} FROM features_dirty
            WHERE price_std IS NOT NULL AND momentum_1h IS NOT NULL
              AND isfinite(price_volatility)"""
    ),
    # Time series and windows
    "top_hub": _with(
        """SELECT settlement_point, count(*) AS n_rows FROM market GROUP BY 1
           ORDER BY 2 DESC, 1 LIMIT 1"""
    ),
    "hourly_mean": _with(
        f"SELECT settlement_point, timestamp, {_r('price')} AS price FROM hourly"
    ),
    "hourly_spine": _with(
        f"SELECT settlement_point, timestamp, {_r('price')} AS price FROM spine"
    ),
    "hourly_filled": _with(
        f"SELECT settlement_point, timestamp, {_r('price')} AS price FROM series"
    ),
    "sliding_windows": _with(
        f"""SELECT settlement_point, window_id::INTEGER AS window_id, window_start_time,
                   window_end_time, target_time, {_r("target_price")} AS target_price
            FROM windows"""
    ),
    "window_sequences": _with(
        f"""SELECT settlement_point, window_id::INTEGER AS window_id,
                   {_SEQUENCE.format("prices")} AS prices,
                   list_aggregate(list_transform(times,
                       lambda t: strftime(t, '%Y-%m-%d %H:%M')), 'string_agg', ',') AS times
            FROM windows"""
    ),
    # Window features
    "feature_matrix": _with(f"SELECT {_FEATURE_LIST} FROM features"),
    "feature_matrix_top_hub": _with(
        f"""SELECT {_FEATURE_LIST} FROM features
            WHERE settlement_point = (SELECT settlement_point FROM market GROUP BY 1
                                      ORDER BY count(*) DESC, 1 LIMIT 1)"""
    ),
    "parse_sequence": _with(
        f"""SELECT settlement_point, window_id::INTEGER AS window_id, 24::INTEGER AS n_prices,
                   CASE WHEN window_id % 9 <> 4 THEN {_SEQUENCE.format("prices")}
                        ELSE rtrim(repeat(printf('%.6f', target_price) || ',', 24), ',') END
                       AS prices
            FROM windows"""
    ),
    # Aggregations and reports
    "ingest_stats": _with(
        """SELECT min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp,
                  min(price) AS min_price, max(price) AS max_price,
                  count(DISTINCT settlement_point) AS unique_points FROM market"""
    ),
    "load_summary": _with(
        """SELECT count(*) AS n_rows, count(*) > 1000 AS enough_rows,
                  min(timestamp) AS min_timestamp, max(timestamp) AS max_timestamp,
                  count(DISTINCT timestamp) AS unique_timestamps,
                  count(DISTINCT settlement_point) AS unique_points,
                  min(price) AS min_price, max(price) AS max_price
           FROM market WHERE timestamp >= (SELECT max(timestamp) FROM market) - INTERVAL 7 DAY"""
    ),
    "feature_stats": _with(
        f"""SELECT count(*) AS total_records, count(DISTINCT window_id) AS unique_windows,
                   {_r("min(target_price)")} AS min_target_price,
                   {_r("max(target_price)")} AS max_target_price,
                   {_r("avg(price_mean)")} AS avg_price_mean,
                   {_r("avg(price_std)")} AS avg_price_std,
                   {_r("avg(trend_slope)")} AS avg_trend_slope
            FROM features"""
    ),
    "null_audit": _with(
        """SELECT *, null_price_mean + null_price_std + null_trend_slope + null_target_price
                      AS total_nulls
           FROM (SELECT count(*) - count(price_mean) AS null_price_mean,
                        count(*) - count(price_std) AS null_price_std,
                        count(*) - count(trend_slope) AS null_trend_slope,
                        count(*) - count(target_price) AS null_target_price
                 FROM features_dirty)"""
    ),
    "feature_overview": _with(
        "\nUNION ALL\n".join(
            f"SELECT '{c}' AS feature, {_r(f'avg({c})')} AS mean, "
            f"{_r(f'stddev_samp({c})')} AS std FROM features"
            for c in ("price_mean", "price_std", "trend_slope", "price_volatility")
        )
    ),
    "target_stats": _with(
        f"""SELECT {_r("avg(target_price)")} AS mean_target,
                   {_r("stddev_pop(target_price)")} AS std_target,
                   {_r("min(target_price)")} AS min_target,
                   {_r("max(target_price)")} AS max_target FROM features"""
    ),
    "type_counts": _with(
        """SELECT 'market_observation' AS type, count(*) AS n FROM market
           UNION ALL SELECT 'market_analysis', count(*) FROM features"""
    ),
    "baseline_stats": _with(
        f"""SELECT {_r("baseline_price")} AS baseline_price, {_r("price_std")} AS price_std
            FROM baseline"""
    ),
    "preview_topn": _with(
        f"""SELECT settlement_point, window_id, target_time, {_r("target_price")} AS target_price,
                   price_mean, price_std, trend_slope
            FROM features ORDER BY window_id, settlement_point LIMIT 5"""
    ),
    # Model data, forecasting, evaluation
    "assemble": _with(
        f"""SELECT settlement_point, window_id,
                   concat_ws(',', {_listed(f"printf('%.6f', {c}::DOUBLE)" for c in FEATURE_NAMES)})
                       AS features,
                   target_price AS label FROM features"""
    ),
    "split_train_test": _with(
        f"""SELECT settlement_point, window_id, target_time, {_r("target_price")} AS target_price,
                   is_test
            FROM features JOIN split USING (settlement_point, window_id)"""
    ),
    "split_in_time": _with(
        f"""SELECT settlement_point, window_id, target_time, {_r("target_price")} AS target_price,
                   epoch_us(target_time) >= last - floor((last - first) * 0.2) AS is_test
            FROM (SELECT *, epoch_us(min(target_time) OVER ()) AS first,
                         epoch_us(max(target_time) OVER ()) AS last FROM features)"""
    ),
    "standardize": _with(
        f"""SELECT settlement_point, window_id, is_test, {_listed(map(_standard, FEATURE_NAMES))}
            FROM features JOIN split USING (settlement_point, window_id)"""
    ),
    "forecast_baseline": _with(
        f"""SELECT row_id, timestamp AS target_time,
                   {_r('''least(greatest((SELECT baseline_price FROM baseline) *
                       CASE WHEN hour(timestamp) BETWEEN 14 AND 18 THEN 1.4
                            WHEN hour(timestamp) <= 6 THEN 0.7
                            WHEN isodow(timestamp) >= 6 THEN 0.9 ELSE 1.0 END, 15.0), 100.0)''', 2)}
                       AS predicted_price,
                   'USD/MWh' AS currency, 0.65::DOUBLE AS confidence, 'Baseline' AS model_type,
                   hour(timestamp)::INTEGER AS hour_of_day,
                   (isodow(timestamp) - 1)::INTEGER AS day_of_week,
                   (isodow(timestamp) >= 6)::INTEGER AS is_weekend,
                   (hour(timestamp) BETWEEN 14 AND 18)::INTEGER AS is_peak_hour
            FROM market"""
    ),
    "forecast_bulk": _with(_BY_RULE),
    "forecast_few_rows": _with(_BY_RULE),
    "forecast_fallback": _with(
        """SELECT row_id, requested, target_time,
                  CASE WHEN target_time IS NOT NULL THEN 35.0::DOUBLE END AS predicted_price,
                  CASE WHEN target_time IS NOT NULL THEN 0.5::DOUBLE END AS confidence,
                  CASE WHEN target_time IS NOT NULL THEN 'Fallback' END AS model_type,
                  CASE WHEN target_time IS NULL THEN 'Invalid timestamp format' ELSE 'no price' END
                      AS error
           FROM asked"""
    ),
    "rf_forecast": _with(
        """SELECT count(*) AS scored_rows, count(*) AS same_when_reloaded, count(*) AS same_by_nodes,
                  true AS predictions_differ, true AS fits
           FROM features"""
    ),
    "forecast_given_forest": _with(_given_forest()),
    "forecast_one_split": _with(
        f"""SELECT row_id, timestamp AS target_time,
                   {_r("least(greatest(mean * factor, 15), 100)", 2)} AS predicted_price
            FROM (SELECT *, CASE WHEN [hour(timestamp), isodow(timestamp) - 1, (isodow(timestamp) >= 6)::INTEGER,
                                       (hour(timestamp) BETWEEN 14 AND 18)::INTEGER][input] <= cut THEN low ELSE high END AS mean,
                         CASE WHEN hour(timestamp) BETWEEN 14 AND 18 THEN 1.3 WHEN hour(timestamp) <= 6 THEN 0.8 ELSE 1.0 END::DOUBLE
                             AS factor
                  FROM market, best_split)""",
        **_BEST_SPLIT,
    ),
    "forecast_model": _with(
        """SELECT row_id, timestamp AS target_time, true AS same_price,
                  'USD/MWh' AS currency, 0.85::DOUBLE AS confidence,
                  'RandomForest' AS model_type,
                  hour(timestamp)::INTEGER AS hour_of_day,
                  (isodow(timestamp) - 1)::INTEGER AS day_of_week,
                  (isodow(timestamp) >= 6)::INTEGER AS is_weekend,
                  (hour(timestamp) BETWEEN 14 AND 18)::INTEGER AS is_peak_hour
           FROM market"""
    ),
    "parse_request_ts": _with("SELECT row_id, requested, target_time FROM asked"),
    "eval_metrics": _with(
        f"""SELECT {_r("sqrt(avg(e * e))")} AS rmse, {_r("avg(abs(e))")} AS mae,
                   {_r("1 - sum(e * e) / sum((actual - m) * (actual - m))")} AS r2
            FROM (SELECT actual, predicted - actual AS e, avg(actual) OVER () AS m
                  FROM predictions)"""
    ),
    "eval_baselines": _with(
        f"""SELECT {_listed(
            f"{_r(f'{n}_{k}')} AS {n}_{k}"
            for k in ("rmse", "mae") for n in ("model", "mean", "last", "hour")
        )},
            {_listed(
                f"{_r(f'({n}_rmse - model_rmse) * 100 / {n}_rmse')} AS gain_over_{n}_pct"
                for n in ("mean", "last", "hour")
            )},
            {_listed(f"model_rmse < {n}_rmse AS better_than_{n}" for n in ("mean", "last", "hour"))}
            FROM (SELECT {_errors("model", "predicted - actual")},
                         {_errors("mean", "mean_actual - actual")},
                         {_errors("last", "last_actual - actual")},
                         {_errors("hour", "hour_actual - actual")}
                  FROM (SELECT *, lag(actual) OVER (PARTITION BY settlement_point
                                                    ORDER BY target_time) AS hour_actual,
                               avg(actual) FILTER (WHERE NOT is_test) OVER () AS mean_actual,
                               (SELECT avg(actual) FROM
                                   (SELECT actual FROM predictions JOIN split
                                        USING (settlement_point, window_id)
                                    WHERE NOT is_test ORDER BY k DESC LIMIT 3)) AS last_actual
                        FROM predictions JOIN split USING (settlement_point, window_id))
                  WHERE is_test)"""
    ),
    "error_profile": _with(
        f"""SELECT {_r("avg(e)")} AS bias, {_r("stddev_pop(e)")} AS error_std,
                   {_r("max(abs(e))")} AS max_abs_error, {_r("avg(p)")} AS mean_abs_pct_error,
                   {_r("median(p)")} AS median_abs_pct_error
            FROM (SELECT predicted - actual AS e,
                         CASE WHEN actual <> 0 THEN abs((predicted - actual) / actual) * 100 END AS p
                  FROM predictions)"""
    ),
    "pred_vs_actual": _with(
        f"""SELECT settlement_point, window_id, target_time, {_r("actual")} AS actual,
                   {_r("predicted")} AS predicted, {_r("predicted - actual")} AS error,
                   {_r('''CASE WHEN actual <> 0 THEN (predicted - actual) / actual * 100
                          ELSE 0 END''')} AS error_pct
            FROM predictions"""
    ),
    "metric_history": f"""
        SELECT run, epoch, {_r("train_loss")} AS train_loss, {_r("val_loss")} AS val_loss,
               {_r("CASE WHEN before <> 0 THEN (before - val_loss) * 100 / before END")}
                   AS change_pct,
               coalesce(val_loss < best, true) AS is_best,
               {_r("(first_loss - last_loss) * 100 / first_loss")} AS reduction_pct,
               last_loss < first_loss AS loss_decreased
        FROM (SELECT *, lag(val_loss) OVER o AS before,
                     min(val_loss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                         AS best,
                     first_value(train_loss) OVER o AS first_loss,
                     last_value(train_loss) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING
                                                  AND UNBOUNDED FOLLOWING) AS last_loss
              FROM (SELECT event_type AS run, day(ts)::INTEGER AS epoch,
                           avg(value) AS train_loss, stddev_pop(value) AS val_loss
                    FROM events GROUP BY 1, 2)
              WINDOW o AS (PARTITION BY run ORDER BY epoch))""",
    # Documents, retrieval, pairs, comparison
    "docs_observation": _with("SELECT * EXCLUDE (row_id) FROM docs_observation"),
    "docs_analysis": _with("SELECT * FROM docs_analysis"),
    "docs_all": _with(
        """SELECT doc_id, text, type, timestamp, settlement_point FROM docs_observation
           UNION ALL SELECT doc_id, text, type, timestamp, NULL FROM docs_analysis"""
    ),
    "docs_upsert": _with(
        """SELECT doc_id, text, price, row_id FROM (
               SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY row_id DESC) AS n
               FROM docs_observation) WHERE n = 1"""
    ),
    "encode_text": _with(
        """SELECT doc_id,
                  list_aggregate(list(printf('%.6f', coalesce(x, 0.0)) ORDER BY slot), 'string_agg', ',')
                      AS vector
           FROM (SELECT doc_id, unnest(generate_series(0, 383)) AS slot FROM documents)
           LEFT JOIN term_vectors USING (doc_id, slot)
           GROUP BY 1"""
    ),
    "embed_documents": _with(
        "SELECT doc_id, failed, CASE WHEN NOT failed THEN vector END AS vector FROM encoded"
    ),
    "embedding_report": _with(
        """SELECT count(*) FILTER (WHERE NOT failed) AS stored,
                  count(*) FILTER (WHERE failed) AS failed FROM encoded"""
    ),
    "vector_audit": """
        SELECT vector_count, unique_ids, null_vectors, wrong_length, min_length, max_length,
               document_count, missing_ids,
               wrong_length = 0 AND null_vectors = 0 AND missing_ids = 0
                   AND vector_count = document_count AS consistent
        FROM (SELECT count(*) AS vector_count, count(DISTINCT vec_id) AS unique_ids,
                     count(*) - count(embedding) AS null_vectors,
                     count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_length,
                     min(len(embedding))::INTEGER AS min_length,
                     max(len(embedding))::INTEGER AS max_length,
                     (SELECT count(*) FROM documents) AS document_count,
                     (SELECT count(*) FROM documents
                      WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS missing_ids
              FROM embeddings)""",
    "cosine_topk": _with(
        f"SELECT query_id, doc_id, {_r('similarity')} AS similarity, rank FROM hits"
    ),
    "cosine_topk_ivf": """SELECT count(DISTINCT label) AS queries, true AS recall_reached,
                                 true AS similarities_agree FROM embeddings""",
    "cosine_topk_ivf_exact": _with(
        f"SELECT query_id, doc_id, {_r('similarity')} AS similarity, rank FROM hits"
    ),
    "cosine_topk_lsh": """SELECT count(DISTINCT label) AS queries, true AS recall_reached,
                                 true AS similarities_agree FROM embeddings""",
    "render_hits": _with("SELECT query_id, rank, doc_id, type, doc_text FROM rendered"),
    "response_context": _with(
        f"""SELECT query_id, 5::BIGINT AS retrieved_documents, rank, doc_id,
                   {_r("similarity", 3)} AS similarity, type
            FROM rendered WHERE rank <= 3"""
    ),
    "build_prompt": _with(
        """SELECT query_id, question,
                  'Context: ' || context || chr(10) || chr(10) || 'Q: ' || question
                      || chr(10) || 'A:' AS prompt
           FROM (SELECT query_id, 'What is known about group ' || query_id || '?' AS question,
                        string_agg(doc_text, ' ' ORDER BY rank) FILTER (WHERE rank <= 3) AS context
                 FROM rendered GROUP BY 1)"""
    ),
    "clean_answer": f"""
        SELECT conv_id, turn,
               CASE WHEN len(kept) = 0 THEN
                    'I''m not sure how to answer that question based on the available market data.'
                    ELSE
                    list_aggregate(kept[1:3], 'string_agg', '. ') || '.' END AS answer
        FROM (SELECT conv_id, turn, list_filter(long, lambda x, i:
                         NOT list_contains(long[1:i - 1], x)) AS kept
              FROM (SELECT conv_id, turn,
                           list_filter({_TRIMMED}, lambda x: length(x) > 10) AS long
                    FROM (SELECT conv_id, turn,
                                 CASE WHEN turn % 2 = 1 THEN text
                                      ELSE substr(text, length(string_split(text, ' ')[1]) + 1) END
                                     AS answer
                          FROM conversations)))""",
    "nearest_feature": _with(
        """SELECT row_id, timestamp, feature_target_time, feature_settlement_point,
                  feature_window_id, feature_target_price, feature_trend_slope,
                  feature_price_volatility, feature_momentum_1h FROM near_any"""
    ),
    "nearest_feature_by_point": _with(
        """SELECT row_id, timestamp, settlement_point, feature_target_time, feature_window_id,
                  feature_trend_slope FROM near"""
    ),
    "qa_price_forecast": _with(f"SELECT * EXCLUDE (pair_key) FROM ({_pair(qa.FORECAST)})"),
    "qa_dispatch": _with(f"SELECT * EXCLUDE (pair_key) FROM ({_pair(qa.DISPATCH)})"),
    "dispatch_recommendation": _with(
        f"""SELECT row_id, price, {_dispatch(0)} AS recommendation, {_dispatch(1)} AS reason
            FROM market"""
    ),
    "qa_market_analysis": _with(f"SELECT * EXCLUDE (pair_key) FROM ({_pair(qa.MARKET)})"),
    "qa_operational": _with(f"SELECT * EXCLUDE (pair_key) FROM ({_pair(qa.OPERATIONAL)})"),
    "qa_technical": _with(f"SELECT * EXCLUDE (pair_key) FROM ({_pair(qa.TECHNICAL)})"),
    "qa_pairs": _with(_sampled(qa.SHARES)),
    "qa_text": _with(
        f"""SELECT type, pair_key,
                   'Q: ' || question || chr(10) || 'A: ' || answer || '<|endoftext|>' AS text
            FROM ({_sampled(qa.ALL)})"""
    ),
    "model_comparison": _with(
        f"""SELECT {_r("avg(base)")} AS avg_base_perplexity,
                   {_r("avg(tuned)")} AS avg_fine_tuned_perplexity,
                   {_r("(avg(base) - avg(tuned)) * 100 / avg(base)")} AS improvement_pct,
                   count(*) FILTER (WHERE tuned < base) AS questions_improved,
                   count(*) AS total_questions, avg(tuned) < avg(base) AS test_passed
            FROM scored"""
    ),
    # Streaming
    "ingest_stats_incremental": """
        SELECT count(*) AS n_rows, min(ts) AS min_timestamp, max(ts) AS max_timestamp,
               min(value) FILTER (event_id % 50 <> 7) AS min_price, max(value) FILTER (event_id % 50 <> 7) AS max_price,
               count(DISTINCT event_type) AS unique_points, true AS times_within_error
        FROM events""",
    "type_counts_incremental": "SELECT event_type AS settlement_point, count(*) AS n_rows FROM events GROUP BY 1",
    "top_hub_incremental": """
        SELECT event_type AS settlement_point, count(*) AS n_rows FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "points_in_both_spans": """
        SELECT count(*) AS points_in_both
        FROM (SELECT event_type FROM events WHERE ts < '2024-01-11'
              INTERSECT SELECT event_type FROM events WHERE ts >= '2024-01-20')""",
    "median_incremental": f"""
        SELECT {_r("median(value)")} AS median_price, true AS sketch_within_error FROM events WHERE event_id % 50 <> 7""",
    "stream_ingest": _with(_feed("pjm_rows")),
    "stream_hourly": _with(
        f"SELECT settlement_point, timestamp, {_r('price')} AS price FROM hourly"
    ),
    "stream_dedupe": _with(
        """SELECT DISTINCT 'ERCOT' AS iso, settlement_point,
                  CASE WHEN row_id % 97 = 5 THEN NULL
                       WHEN row_id % 1009 = 1 THEN timestamp - INTERVAL 400 DAY ELSE timestamp END AS timestamp,
                  unnest(CASE WHEN row_id % 50 = 7 THEN [price, price + 1] ELSE [price] END) AS price
           FROM market"""
    ),
}
