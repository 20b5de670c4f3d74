"""The registered queries as SQL for DuckDB, from the same tables; recurrences are recursive CTEs."""

from __future__ import annotations

import re

TICKS = """ticks AS (
  SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, event_id, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS vol
  FROM events WHERE value > 0
)"""


def _ohlc(name: str, tf: str, bucket: str, ticks: str = "ticks", order: str = "ts, event_id") -> str:
    return f"""{name} AS (
  SELECT symbol, '{tf}' AS timeframe, {bucket} AS ts, first(price ORDER BY {order}) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY {order}) AS close, sum(vol) AS volume FROM {ticks} GROUP BY symbol, {bucket}
)"""


def _coarser(name: str, tf: str, interval: str) -> str:
    bucket = f"time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01')"
    return f"""{name} AS (
  SELECT symbol, '{tf}' AS timeframe, {bucket} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
    last(close ORDER BY ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, {bucket}
)"""


BARS = TICKS + ",\n" + _ohlc("bars", "1H", "date_trunc('hour', ts)")


def _pos(source: str = "bars", name: str = "b") -> str:
    return f"""{name} AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM {source} WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY ts)
)"""


def _averages(source: str = "b", name: str = "ind") -> str:
    """Every exponential average in one recursion over the position."""
    return f"""rec_{name} AS (
  SELECT symbol, timeframe, pos, close AS e12, close AS e20, close AS e26, close AS e50, high - low AS atr, CAST(0 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS loss, CAST(0 AS DOUBLE) AS sig
  FROM {source} WHERE pos = 0
  UNION ALL
  SELECT n.symbol, n.timeframe, n.pos, r.e12 + 2.0 / 13 * (n.close - r.e12), r.e20 + 2.0 / 21 * (n.close - r.e20), r.e26 + 2.0 / 27 * (n.close - r.e26), r.e50 + 2.0 / 51 * (n.close - r.e50),
    r.atr + (n.tr - r.atr) / 14,
    CASE WHEN n.pos = 1 THEN greatest(n.close - n.pc, 0) ELSE r.gain + (greatest(n.close - n.pc, 0) - r.gain) / 14 END,
    CASE WHEN n.pos = 1 THEN greatest(n.pc - n.close, 0) ELSE r.loss + (greatest(n.pc - n.close, 0) - r.loss) / 14 END,
    r.sig + 2.0 / 10 * ((r.e12 + 2.0 / 13 * (n.close - r.e12)) - (r.e26 + 2.0 / 27 * (n.close - r.e26)) - r.sig)
  FROM rec_{name} r JOIN {source} n ON n.symbol = r.symbol AND n.timeframe = r.timeframe AND n.pos = r.pos + 1
), {name} AS (
  SELECT n.*, r.* EXCLUDE (symbol, timeframe, pos), coalesce(100 - 100 / (1 + r.gain / nullif(r.loss, 0)), 100.0) AS rsi
  FROM {source} n JOIN rec_{name} r USING (symbol, timeframe, pos)
)"""


SWINGS = """sw AS (
  SELECT *, CASE WHEN count(*) OVER c = 11 AND high = max(high) OVER c THEN high END AS swing_high,
    CASE WHEN count(*) OVER c = 11 AND low = min(low) OVER c THEN low END AS swing_low
  FROM {source} WINDOW c AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
)"""

ZONE = "STRUCT(head DOUBLE, tail DOUBLE, total DOUBLE, n INTEGER, low INTEGER)[]"


def _zones(points: str) -> str:
    """Zones of a sorted list of (p, low) structs, as a fold."""
    return f"""list_reduce(list_transform({points}, lambda q: CAST([{{'head': q.p, 'tail': q.p, 'total': q.p, 'n': 1, 'low': q.low}}] AS {ZONE})),
      lambda a, x: CASE WHEN x[1].head - a[len(a)].tail <= a[len(a)].head * 0.003
        THEN list_concat(a[1:len(a) - 1], CAST([{{'head': a[len(a)].head, 'tail': x[1].head, 'total': a[len(a)].total + x[1].head, 'n': a[len(a)].n + 1, 'low': a[len(a)].low + x[1].low}}] AS {ZONE}))
        ELSE list_concat(a, x) END)"""


def _points(highs: str, lows: str) -> str:
    return f"list_sort(list_concat(list_transform({highs}, lambda h: {{'p': h, 'low': 0}}), list_transform({lows}, lambda h: {{'p': h, 'low': 1}})))"


_NEAR = "list_sort(list_transform(zl, lambda z: {'d': abs(z.total / z.n - close), 'price': z.total / z.n, 'top': z.tail, 'bottom': z.head, 'kind': CASE WHEN z.low * 2 >= z.n THEN 'support' ELSE 'resistance' END, 'touches': z.n}))[1]"

ROLLING = f"""roll0 AS (
  SELECT *, list(swing_high) FILTER (WHERE swing_high IS NOT NULL) OVER t AS hs, list(swing_low) FILTER (WHERE swing_low IS NOT NULL) OVER t AS ls
  FROM sw WINDOW t AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 145 PRECEDING AND 5 PRECEDING)
), roll1 AS (
  SELECT *, CASE WHEN pos < 60 THEN 0 WHEN len(hs) >= 2 AND close > hs[len(hs) - 1] THEN 1 WHEN len(ls) >= 2 AND close < ls[len(ls) - 1] THEN -1 ELSE 0 END AS smc_bias,
    CASE WHEN pos >= 60 AND len(coalesce(hs, [])) + len(coalesce(ls, [])) > 0 THEN {_zones(_points("coalesce(hs, [])", "coalesce(ls, [])"))} END AS zl
  FROM roll0
), roll AS (SELECT *, CASE WHEN zl IS NOT NULL THEN {_NEAR} END AS near FROM roll1)"""

ENTROPY = """ent0 AS (
  SELECT *, ln(close) - ln(pc) AS r FROM {source}
), ent1 AS (
  SELECT *, min(r) OVER s AS lo, max(r) OVER s AS hi FROM ent0 WINDOW s AS (PARTITION BY symbol, timeframe)
), ent2 AS (
  SELECT *, CASE WHEN r IS NULL THEN NULL ELSE list_filter(range(10), lambda k: r >= lo + (hi - lo) / 10 * k AND (CASE WHEN k = 9 THEN r <= hi ELSE r < lo + (hi - lo) / 10 * (k + 1) END))[1] END AS bin FROM ent1
), ent3 AS (
  SELECT *, count(r) OVER t AS n_r, """ + ", ".join(f"count(*) FILTER (WHERE bin = {k}) OVER t AS c{k}" for k in range(10)) + """
  FROM ent2 WINDOW t AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)
), ent AS (
  SELECT *, CASE WHEN n_r = 20 AND hi > lo THEN (0 - """ + " - ".join(f"(CASE WHEN c{k} > 0 THEN c{k} / 20.0 * log2(c{k} / 20.0) ELSE 0 END)" for k in range(10)) + """) / log2(10) END AS entropy_20 FROM ent3
)"""

MATRIX = ",\n".join(
    [
        BARS,
        _pos(),
        _averages(),
        SWINGS.format(source="ind"),
        ROLLING,
        ENTROPY.format(source="roll"),
        """fm0 AS (
  SELECT symbol, timeframe, ts, rsi / 100 AS rsi, (e12 - e26) / close * 100 AS macd_pct, CAST(sign(e20 - e50) AS DOUBLE) AS ema_cross, atr / close * 100 AS atr_pct,
    ln(close) - ln(pc) AS ret_1, ln(close) - ln(lag(close, 5) OVER (PARTITION BY symbol, timeframe ORDER BY ts)) AS ret_5, entropy_20, smc_bias,
    CASE WHEN atr > 0 THEN near.d / atr END AS zone_dist_atr, CASE WHEN near.d / atr < 0.5 THEN 1 ELSE 0 END AS at_zone, high, low, close
  FROM ent
), fm AS (
  SELECT * FROM fm0 WHERE ret_1 IS NOT NULL AND ret_5 IS NOT NULL AND entropy_20 IS NOT NULL AND zone_dist_atr IS NOT NULL
)""",
    ]
)

LABELED = MATRIX + """, lb0 AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol, timeframe) AS n,
    list({'h': high, 'l': low}) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS nxt,
    close + 2 * (atr_pct / 100 * close) AS up, close - (atr_pct / 100 * close) AS dn
  FROM fm WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY ts)
), lb1 AS (
  SELECT *, list_filter(range(1, 11), lambda k: nxt[k].h >= up OR nxt[k].l <= dn)[1] AS k FROM lb0 WHERE i <= n - 10
), sc0 AS (
  SELECT * EXCLUDE (nxt, i, n), CAST(CASE WHEN k IS NULL OR nxt[k].l <= dn THEN 0 ELSE 1 END AS INTEGER) AS label, CAST(coalesce(k, 10) AS INTEGER) AS label_bars,
    greatest(0.40, least(0.65, 0.5 + (rsi - 0.5) * 0.3 + 0.05 * ema_cross)) AS proba
  FROM lb1
), sc1 AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, timeframe) AS n FROM sc0
), sc AS (
  SELECT *, CAST(CASE WHEN i < n - (n // 6) * 5 THEN 0 ELSE (i - (n - (n // 6) * 5)) // (n // 6) + 1 END AS INTEGER) AS fold FROM sc1
)"""

CONFORMAL = """cal0 AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts) - 1 AS j, count(*) OVER (PARTITION BY symbol, timeframe) AS m FROM sc WHERE fold > 0
), cal1 AS (
  SELECT symbol, timeframe, abs(proba - label) AS s FROM cal0 WHERE j >= floor(m * 0.8)
), cal2 AS (
  SELECT *, count(*) OVER (PARTITION BY symbol, timeframe) AS n_cal, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY s) AS rk FROM cal1
), cq AS (
  SELECT symbol, timeframe, s AS q_hat, CAST(0.1 AS DOUBLE) AS alpha, n_cal, CAST(0.9 AS DOUBLE) AS coverage FROM cal2 WHERE n_cal >= 20 AND rk = least(ceil((n_cal + 1) * 0.9), n_cal)
)"""

EQUITY = """thr AS (SELECT symbol, timeframe, quantile_cont(proba, 0.7) AS threshold FROM sc GROUP BY ALL), eq0 AS (
  SELECT sc.*, threshold, CAST(CASE WHEN proba >= threshold THEN 1 ELSE 0 END AS INTEGER) AS taken,
    CAST(CASE WHEN proba >= threshold THEN CASE WHEN label = 1 THEN 2 ELSE -1 END ELSE 0 END AS DOUBLE) AS pnl_r
  FROM sc JOIN thr USING (symbol, timeframe)
), eq AS (
  SELECT *, sum(pnl_r) OVER (PARTITION BY symbol, timeframe ORDER BY ts) AS equity_r FROM eq0
)"""

METRICS = """m0 AS (
  SELECT *, nullif(pnl_r - lag(pnl_r) OVER w, 0) AS ret, equity_r - max(equity_r) OVER w AS down FROM eq WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY ts)
), m1 AS (
  SELECT symbol, timeframe, sum(taken) AS trades, sum(label) FILTER (WHERE taken = 1) AS wins, arg_max(equity_r, ts) AS last, count(ret) AS n_ret, avg(ret) AS mean,
    stddev_samp(ret) AS sd, stddev_samp(ret) FILTER (WHERE ret < 0) AS sd_loss, min(down) AS dd, avg((proba - label) ** 2) AS brier, max(threshold) AS threshold,
    arg_max(proba, ts) AS last_proba FROM m0 GROUP BY ALL
), m AS (
  SELECT symbol, timeframe, CAST(trades AS BIGINT) AS total_trades, round(coalesce(wins / nullif(trades, 0), 0), 4) AS win_rate, round(last, 2) AS total_profit_r, round(last * 0.02, 2) AS total_profit_pct,
    round(coalesce(CASE WHEN n_ret > 10 AND sd > 0 THEN mean / sd * sqrt(6048) END, 0), 3) AS sharpe,
    round(coalesce(CASE WHEN n_ret > 10 AND sd > 0 AND sd_loss > 0 THEN mean / sd_loss * sqrt(6048) END, 0), 3) AS sortino,
    round(coalesce(CASE WHEN dd < 0 THEN last / abs(dd) END, 0), 3) AS calmar, round(dd, 2) AS max_drawdown_r, round(brier, 4) AS brier_score, round(threshold, 4) AS threshold, last_proba
  FROM m1
)"""

LEGS = """prep AS (
  SELECT *, avg(tr) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS atr_long FROM b
), prep2 AS (
  SELECT *, CASE WHEN high - low >= 2 * atr_long THEN low ELSE high END AS parsed_high, CASE WHEN high - low >= 2 * atr_long THEN high ELSE low END AS parsed_low FROM prep
), leg0 AS (
  SELECT *, CASE WHEN lag(high, {z}) OVER o > max(high) OVER z THEN 0 WHEN lag(low, {z}) OVER o < min(low) OVER z THEN 1 END AS s
  FROM prep2 WINDOW o AS (PARTITION BY symbol, timeframe ORDER BY ts), z AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN {y} PRECEDING AND CURRENT ROW)
), leg AS (
  SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS leg FROM leg0
), piv AS (
  SELECT *, leg <> coalesce(lag(leg) OVER o, 0) AS flip, lag(high, {z}) OVER o AS hz, lag(low, {z}) OVER o AS lz, lag(atr_long, {z}) OVER o AS az FROM leg WINDOW o AS (PARTITION BY symbol, timeframe ORDER BY ts)
), pv AS (
  SELECT symbol, timeframe, pos - {z} AS pos, pos AS confirmed, CASE WHEN leg = 0 THEN hz ELSE lz END AS price, CASE WHEN leg = 0 THEN 'high' ELSE 'low' END AS kind, az FROM piv WHERE flip
), pvl AS (
  SELECT *, lag(price) OVER (PARTITION BY symbol, timeframe, kind ORDER BY confirmed) AS last FROM pv
)"""

BREAKS = """lev AS (
  SELECT *, last_value(CASE WHEN flip AND leg = 0 THEN hz END IGNORE NULLS) OVER p AS h, last_value(CASE WHEN flip AND leg = 0 THEN pos - {z} END IGNORE NULLS) OVER p AS hp,
    last_value(CASE WHEN flip AND leg = 1 THEN lz END IGNORE NULLS) OVER p AS l, last_value(CASE WHEN flip AND leg = 1 THEN pos - {z} END IGNORE NULLS) OVER p AS lp
  FROM piv WINDOW p AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), br0 AS (
  SELECT symbol, timeframe, min(pos) AS pos, hp AS pivot_pos, min(h) AS level, 'bull' AS side FROM lev WHERE close > h AND pc <= h GROUP BY symbol, timeframe, hp
  UNION ALL
  SELECT symbol, timeframe, min(pos), lp, min(l), 'bear' FROM lev WHERE close < l AND pc >= l GROUP BY symbol, timeframe, lp
), br AS (
  SELECT *, CASE WHEN lag(side) OVER (PARTITION BY symbol, timeframe ORDER BY pos, CASE WHEN side = 'bull' THEN 0 ELSE 1 END) <> side THEN 'CHoCH' ELSE 'BOS' END AS tag FROM br0
)"""

BLOCKS = """ob AS (
  SELECT br.symbol, br.timeframe, br.side, br.pos AS break_pos, arg_min(x.pos, {'v': CASE WHEN side = 'bull' THEN parsed_low ELSE -parsed_high END, 'p': x.pos}) AS x
  FROM br JOIN prep2 x ON x.symbol = br.symbol AND x.timeframe = br.timeframe AND x.pos BETWEEN br.pivot_pos AND br.pos GROUP BY ALL
), obs AS (SELECT ob.*, p.parsed_high AS top, p.parsed_low AS bottom FROM ob JOIN prep2 p ON p.symbol = ob.symbol AND p.timeframe = ob.timeframe AND p.pos = ob.x),
mit AS (
  SELECT o.*, (SELECT min(p.pos) FROM b p WHERE p.symbol = o.symbol AND p.timeframe = o.timeframe AND p.pos > o.x AND CASE WHEN o.side = 'bull' THEN p.low < o.bottom ELSE p.high > o.top END) AS mitigated FROM obs o
)"""

GAPS = """gp AS (
  SELECT *, lag(high, 2) OVER o AS h2, lag(low, 2) OVER o AS l2 FROM {source} WINDOW o AS (PARTITION BY symbol, timeframe ORDER BY ts)
), gaps AS (
  SELECT symbol, timeframe, pos - 1 AS x, CASE WHEN low > h2 THEN 'bull' ELSE 'bear' END AS side, CASE WHEN low > h2 THEN low ELSE l2 END AS top, CASE WHEN low > h2 THEN h2 ELSE high END AS bottom
  FROM gp WHERE low > h2 OR high < l2
)"""


def _signed(way: str, sign: str) -> str:
    return ", ".join(f"CASE WHEN coalesce(lag({way}, {k}) OVER o, false) THEN {sign}lag(volume, {k}) OVER o ELSE {'-' if not sign else ''}lag(volume, {k}) OVER o END AS {way}{k}" for k in range(5))


SUPPLY = f"""sd0 AS (
  SELECT *, avg(volume) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean_before, lag(volume) OVER o AS pv,
    2 * avg(tr) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS wide, close < open AS bear, close > open AS bull, count(*) OVER (PARTITION BY symbol, timeframe) AS total
  FROM b WINDOW o AS (PARTITION BY symbol, timeframe ORDER BY ts)
), sd1 AS (
  SELECT *, coalesce(mean_before > 0 AND pv > mean_before, false) AS spike, {_signed("bear", "-")}, {_signed("bull", "")},
    bear AND lag(bear) OVER o AND lag(bear, 2) OVER o AS down3, bull AND lag(bull) OVER o AND lag(bull, 2) OVER o AS up3,
    CASE WHEN lag(bull, 3) OVER o THEN 3 WHEN lag(bull, 4) OVER o THEN 4 WHEN lag(bull, 5) OVER o THEN 5 END AS kb, CASE WHEN lag(bear, 3) OVER o THEN 3 WHEN lag(bear, 4) OVER o THEN 4 WHEN lag(bear, 5) OVER o THEN 5 END AS kd,
    [lag(low, 3) OVER o, lag(low, 4) OVER o, lag(low, 5) OVER o] AS lows, [lag(high, 3) OVER o, lag(high, 4) OVER o, lag(high, 5) OVER o] AS highs
  FROM sd0 WINDOW o AS (PARTITION BY symbol, timeframe ORDER BY ts)
), cand AS (
  SELECT symbol, timeframe, 'supply' AS kind, pos - kb AS x1, pos AS x2, lows[kb - 2] + wide AS top, lows[kb - 2] AS bottom, bear0 + bear1 + bear2 + CASE WHEN kb > 3 THEN bear3 ELSE 0 END + CASE WHEN kb > 4 THEN bear4 ELSE 0 END AS delta
  FROM sd1 WHERE down3 AND spike AND kb IS NOT NULL AND total >= 200
  UNION ALL
  SELECT symbol, timeframe, 'demand', pos - kd, pos, highs[kd - 2], highs[kd - 2] - wide, bull0 + bull1 + bull2 + CASE WHEN kd > 3 THEN bull3 ELSE 0 END + CASE WHEN kd > 4 THEN bull4 ELSE 0 END
  FROM sd1 WHERE up3 AND spike AND kd IS NOT NULL AND total >= 200
)"""

COOLED = """seq AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, timeframe, kind ORDER BY x2) AS rn FROM cand
), pick AS (
  SELECT symbol, timeframe, kind, rn, x2 AS last_x, true AS kept FROM seq WHERE rn = 1
  UNION ALL
  SELECT q.symbol, q.timeframe, q.kind, q.rn, CASE WHEN q.x2 - p.last_x >= 14 THEN q.x2 ELSE p.last_x END, q.x2 - p.last_x >= 14
  FROM pick p JOIN seq q ON q.symbol = p.symbol AND q.timeframe = p.timeframe AND q.kind = p.kind AND q.rn = p.rn + 1
), cool AS (SELECT seq.* EXCLUDE (rn) FROM seq JOIN pick USING (symbol, timeframe, kind, rn) WHERE kept),
alive AS (
  SELECT * FROM cool c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.symbol = c.symbol AND b.timeframe = c.timeframe AND b.pos > c.x2 AND CASE WHEN kind = 'supply' THEN b.close > c.top ELSE b.close < c.bottom END)
), stand AS (
  SELECT * FROM alive a WHERE NOT EXISTS (SELECT 1 FROM alive z WHERE z.symbol = a.symbol AND z.timeframe = a.timeframe AND z.kind = a.kind AND a.top <= z.top AND a.bottom >= z.bottom
    AND (abs(z.delta) > abs(a.delta) OR (abs(z.delta) = abs(a.delta) AND z.x2 < a.x2)))
), latest AS (
  SELECT *, sum(abs(delta)) OVER (PARTITION BY symbol, timeframe, kind) AS side_total, sum(abs(delta)) OVER (PARTITION BY symbol, timeframe) AS every
  FROM (SELECT * FROM stand QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, kind ORDER BY x2 DESC) <= 5)
)"""

PROFILE = """vd AS (SELECT *, CAST(ts AS DATE) AS day FROM bars), days AS (
  SELECT symbol, timeframe, day, min(low) AS lo, max(high) AS hi FROM vd GROUP BY ALL HAVING count(*) >= 3 AND max(high) > min(low)
), grid AS (
  SELECT *, ((lo + bin * ((hi - lo) / 100)) + (lo + (bin + 1) * ((hi - lo) / 100))) / 2 AS center FROM days, (SELECT CAST(unnest(range(100)) AS INTEGER) AS bin)
), hits AS (
  SELECT g.symbol, g.timeframe, g.day, g.bin, v.ts, v.volume / count(*) OVER (PARTITION BY v.symbol, v.timeframe, v.ts) AS part
  FROM vd v JOIN grid g ON g.symbol = v.symbol AND g.timeframe = v.timeframe AND g.day = v.day AND g.center BETWEEN v.low AND v.high WHERE v.high > v.low AND v.volume > 0
), sums AS (SELECT symbol, timeframe, day, bin, sum(part ORDER BY ts) AS volume FROM hits GROUP BY ALL), vbins AS (
  SELECT g.symbol, g.timeframe, g.day, g.bin, g.center, coalesce(s.volume, 0) AS volume FROM grid g LEFT JOIN sums s USING (symbol, timeframe, day, bin)
  WHERE (g.symbol, g.timeframe, g.day) IN (SELECT (symbol, timeframe, day) FROM sums)
), poc AS (SELECT symbol, timeframe, day, arg_min(bin, {'v': -volume, 'b': bin}) AS p, sum(volume ORDER BY bin) AS total, max(volume) AS top FROM vbins GROUP BY ALL), grow AS (
  SELECT symbol, timeframe, day, p AS lo_i, p AS hi_i, top AS acc, total, 0 AS step FROM poc
  UNION ALL
  SELECT g.symbol, g.timeframe, g.day, CASE WHEN coalesce(u.volume, -1) >= coalesce(d.volume, -1) THEN lo_i ELSE lo_i - 1 END, CASE WHEN coalesce(u.volume, -1) >= coalesce(d.volume, -1) THEN hi_i + 1 ELSE hi_i END,
    acc + greatest(coalesce(u.volume, -1), coalesce(d.volume, -1)), total, step + 1
  FROM grow g LEFT JOIN vbins u ON u.symbol = g.symbol AND u.day = g.day AND u.bin = g.hi_i + 1 LEFT JOIN vbins d ON d.symbol = g.symbol AND d.day = g.day AND d.bin = g.lo_i - 1
  WHERE acc < total * 0.7 AND NOT (u.volume IS NULL AND d.volume IS NULL)
), area AS (SELECT symbol, timeframe, day, arg_max(lo_i, step) AS lo_i, arg_max(hi_i, step) AS hi_i FROM grow GROUP BY ALL)"""

DAILY = """ot AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS TIMESTAMP) AS ts, o_orderkey, o_totalprice AS price, CAST(1 AS DOUBLE) AS vol FROM orders),
""" + _ohlc("daily", "1D", "CAST(CAST(ts AS DATE) AS TIMESTAMP)", "ot", "o_orderkey")
MACRO = """macro0 AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) AS dxy, avg(l_quantity) AS vix, 100 * avg(l_tax) AS tnx FROM lineitem GROUP BY 1)"""
HEADS = """heads AS (
  SELECT doc_id, source AS symbol, split_part(text, chr(10), 1) AS title, to_timestamp(1704067200 + (doc_id % 168) * 3600)::TIMESTAMP AS published_at, CAST(quality - toxic AS DOUBLE) AS score
  FROM documents LEFT JOIN labels USING (doc_id)
), recent AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, doc_id) AS INTEGER) AS n FROM heads
  WHERE length(trim(title, ' ')) > 0 AND published_at >= (SELECT max(published_at) FROM heads WHERE length(trim(title, ' ')) > 0) - INTERVAL 72 HOUR QUALIFY n <= 20
)"""
KEYS = "symbol, timeframe"


#: Patterns of the registered news queries' terms, each a whole word or phrase.
_TERMS = {"XAUUSD": "gold|xauusd|gold price", "BTCUSD": "bitcoin|btc", "ETHUSD": "ethereum|eth", "NAS100": "nasdaq", "SPX500": "s&p 500|spx", "click": "the|of the", "view": "der|die der|und", "purchase": "les|de la", "signup": "que|nothing", "error": "the the|con|the"}
_MATCHED = (
    "matched AS (SELECT t.symbol, doc_id, title, published_at, score FROM heads JOIN (VALUES "
    + ", ".join(f"('{s}', '(^|[^\\pL\\pN])({p})([^\\pL\\pN]|$)')" for s, p in _TERMS.items())
    + ") AS t(symbol, pattern) ON regexp_matches(lower(title), t.pattern))"
)


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


OHLC = _r("open", "high", "low", "close", "volume")
IND = (BARS, _pos(), _averages())
NAMES = ["rsi", "macd_pct", "ema_cross", "atr_pct", "ret_1", "ret_5", "entropy_20", "smc_bias", "zone_dist_atr", "at_zone"]
_FM = f"{KEYS}, ts, " + ", ".join(n if n in ("smc_bias", "at_zone") else f"round({n}, 6) AS {n}" for n in [*NAMES, "high", "low", "close"])
#: The catalog's symbols, and the rows a pair of each timeframe needs.
_TABLES = """sy(id) AS (VALUES ('XAUUSD'), ('BTCUSD'), ('ETHUSD'), ('SPX500'), ('NAS100')),
tf(id, min_bars) AS (VALUES ('1m', 300), ('5m', 1000), ('15m', 1000), ('1H', 1500), ('4H', 800), ('1D', 400), ('1W', 200))"""
_B20 = "PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
_TB = "CASE WHEN n < 50 THEN 'neutral' WHEN e20 > e50 THEN 'bullish' WHEN e20 < e50 THEN 'bearish' ELSE 'neutral' END"


def _bias(prefix: str, source: str) -> str:
    """Bias of each series' last bar from its averages."""
    return f"{prefix} AS (SELECT symbol, timeframe, {_TB} AS bias FROM (SELECT symbol, timeframe, count(*) AS n, arg_max(e20, ts) AS e20, arg_max(e50, ts) AS e50 FROM {source} GROUP BY ALL))"


_LAST = """lv AS (
  SELECT e.symbol, e.timeframe, coalesce(h.price, e.mh) AS top, coalesce(l.price, e.ml) AS bottom, CAST(coalesce(h.pos, 0) AS BIGINT) AS top_bar, CAST(coalesce(l.pos, 0) AS BIGINT) AS bottom_bar
  FROM (SELECT symbol, timeframe, max(high) AS mh, min(low) AS ml FROM b GROUP BY ALL) e
  LEFT JOIN (SELECT symbol, timeframe, arg_max(price, confirmed) AS price, arg_max(pos, confirmed) AS pos FROM pv WHERE kind = 'high' GROUP BY ALL) h USING (symbol, timeframe)
  LEFT JOIN (SELECT symbol, timeframe, arg_max(price, confirmed) AS price, arg_max(pos, confirmed) AS pos FROM pv WHERE kind = 'low' GROUP BY ALL) l USING (symbol, timeframe)
)"""


def _attached(source: str) -> str:
    return f"""SELECT {KEYS}, ts, round(close, 6) AS close, round(ln(dxy / lag(dxy) OVER (PARTITION BY symbol ORDER BY ts)), 6) AS dxy_return_1d, round(least(vix / 50, 1), 6) AS vix_level, round(tnx / 10, 6) AS tnx_level FROM {source}"""


def _filled(c: str, part: str) -> str:
    return f"coalesce(last_value({c} IGNORE NULLS) OVER ({part} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER ({part} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


_SKILL = """bs0 AS (SELECT symbol, timeframe, fold, sum((proba - label) ** 2) AS s, count(*) AS n FROM sc WHERE fold > 0 GROUP BY ALL), bs1 AS (
  SELECT symbol, timeframe, avg(s / n) AS fold_brier, sum(s) / sum(n) AS brier, (SELECT avg(label) FROM sc WHERE sc.symbol = bs0.symbol AND sc.timeframe = bs0.timeframe) AS p FROM bs0 GROUP BY ALL
), bs AS (SELECT symbol, timeframe, fold_brier, brier, p * (1 - p) AS reference, 1 - brier / nullif(p * (1 - p), 0) AS skill FROM bs1)"""
_AUC = """rk AS (
  SELECT *, rank() OVER (PARTITION BY symbol, timeframe ORDER BY proba) + (count(*) OVER (PARTITION BY symbol, timeframe, proba) - 1) / 2.0 AS r FROM sc WHERE fold > 0
), au AS (
  SELECT symbol, timeframe, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auc FROM rk GROUP BY ALL
)"""
_TODAY = """td AS (
  SELECT symbol, timeframe, max(equity_r) FILTER (WHERE r = 1) - max(equity_r) FILTER (WHERE r = 2) AS today_r
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) AS r FROM eq) GROUP BY ALL
)"""
_KELLY = "round(greatest((proba * 2 - (1 - proba)) / 2, 0) * 100, 3) AS full_kelly_pct, round(greatest((proba * 2 - (1 - proba)) / 2, 0) * 50, 3) AS half_kelly_pct, round(least(greatest((proba * 2 - (1 - proba)) / 2, 0) / 2, 0.02) * 100, 3) AS final_pct, round(proba * 2 - (1 - proba), 3) AS expected_r"
_T100 = "t100 AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) <= 100)"
_TIERB = (
    _T100,
    _pos("t100", "tb"),
    SWINGS.format(source="tb"),
    f"""tz0 AS (
  SELECT symbol, timeframe, arg_max(close, ts) AS close, list(swing_high ORDER BY ts) FILTER (WHERE swing_high IS NOT NULL) AS hs, list(swing_low ORDER BY ts) FILTER (WHERE swing_low IS NOT NULL) AS ls FROM sw GROUP BY ALL
), tz1 AS (SELECT *, {_zones(_points("coalesce(hs, [])", "coalesce(ls, [])"))} AS zl FROM tz0), tz AS (SELECT *, {_NEAR} AS near FROM tz1), tier AS (
  SELECT symbol, timeframe, close AS price, near.kind AS zone_kind, round(near.price, 2) AS zone_price, round(near.d / close * 100, 3) AS distance_pct, coalesce(near.d / close < 0.003, false) AS at_zone,
    CASE WHEN len(hs) >= 2 AND close > hs[len(hs) - 1] THEN 'bullish' WHEN len(ls) >= 2 AND close < ls[len(ls) - 1] THEN 'bearish' ELSE 'neutral' END AS bias FROM tz
)""",
)
# the chain of the readings' predictions starts again at each series' last 200 bars
_M200 = MATRIX.replace(BARS, BARS.replace("bars AS (", "bars_all AS (") + ",\nbars AS (SELECT * FROM bars_all QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) <= 200)")
_PRED = """pred AS (
  SELECT *, greatest(0.40, least(0.65, 0.5 + (rsi - 0.5) * 0.3 + 0.05 * ema_cross)) AS proba FROM fm QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) = 1
)"""
_SWING, _INNER = LEGS.format(z=10, y=9), LEGS.format(z=4, y=3)



def _renamed(sql: str, suffix: str) -> str:
    """The same CTEs under other names, so that two of a kind fit into one query."""
    names = sorted(set(re.findall(r"(?:^|[,)]\s*|\n)(\w+)(?:\([^()]*\))? AS \(", sql)), key=len, reverse=True)
    return re.sub(r"\b(" + "|".join(names) + r")\b", lambda m: m[0] + suffix, sql)


def _gauss(n: int) -> str:
    """Inverse of each series' n x n matrix in g(symbol, timeframe, m), a list of rows with the unit matrix beside it, row by row."""
    return f"""gj AS (
  SELECT 1 AS k, symbol, timeframe, m FROM g
  UNION ALL
  SELECT k + 1, symbol, timeframe, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k]) ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM gj WHERE k <= {n}
), inv AS (SELECT symbol, timeframe, m FROM gj WHERE k = {n + 1})"""


_SCOPES = {"s": (_SWING, BREAKS.format(z=10), BLOCKS), "i": (_INNER, BREAKS.format(z=4), BLOCKS)}


def _overlay(name: str, tag: str, side: str, x1: str, x2: str, top: str, bottom: str, source: str) -> str:
    return f"SELECT {KEYS}, '{name}' AS overlay, {tag} AS tag, {side} AS side, {x1} AS x1, {x2} AS x2, {top} AS top, {bottom} AS bottom FROM {source}"


_LABEL = "CASE WHEN kind = 'high' THEN CASE WHEN last IS NULL OR price > last THEN 'HH' ELSE 'LH' END ELSE CASE WHEN last IS NULL OR price < last THEN 'LL' ELSE 'HL' END END"
_LIVE12 = "(SELECT * FROM mit_{0} WHERE mitigated IS NULL QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY break_pos DESC, side) <= 12)"
_CHART = (
    BARS,
    "ctx AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) <= 350)",
    _pos("ctx", "b"),
    *(_renamed(",\n".join(parts), f"_{k}") for k, parts in _SCOPES.items()),
    GAPS.format(source="b"),
    SUPPLY,
    COOLED,
    _LAST.replace("FROM pv ", "FROM pv_s "),
    "lb AS (SELECT symbol, timeframe, arg_max(side, pos * 2 + CASE WHEN side = 'bull' THEN 0 ELSE 1 END) AS side FROM br_s GROUP BY ALL)",
    "sz AS (SELECT symbol, timeframe, greatest(least(count(*), 350) - 150, 0) AS shift FROM bars GROUP BY ALL HAVING count(*) >= 30)",
    "ov AS ("
    + "\nUNION ALL ".join(
        [
            _overlay("swing", _LABEL, "kind", "pos", "pos", "price", "price", "pvl_s"),
            _overlay("gap", "''", "side", "x", "x", "top", "bottom", "(SELECT * FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM b p WHERE p.symbol = g.symbol AND p.pos > g.x AND CASE WHEN g.side = 'bull' THEN p.low < g.bottom ELSE p.high > g.top END) QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY x DESC) <= 20)"),
            _overlay("equal", "CASE WHEN kind = 'high' THEN 'EQH' ELSE 'EQL' END", "''", "pos", "pos", "price", "last", "pvl_s WHERE az_s > 0 AND abs(price - last) <= 0.1 * az_s".replace("az_s", "az")),
            _overlay("break_swing", "tag", "side", "pivot_pos", "pos", "level", "level", "br_s"),
            _overlay("break_internal", "tag", "side", "pivot_pos", "pos", "level", "level", "br_i"),
            _overlay("block_swing", "''", "side", "x", "x", "top", "bottom", _LIVE12.format("s")),
            _overlay("block_internal", "''", "side", "x", "x", "top", "bottom", _LIVE12.format("i")),
            _overlay("zone", "''", "kind", "x1", "x2", "top", "bottom", "latest"),
        ]
    )
    + "\n)",
)
_NEWS = HEADS.replace("source AS symbol", "['click', 'view', 'purchase', 'signup', 'error'][doc_id % 5 + 1] AS symbol")
_TAG = "CASE WHEN s > 0.15 THEN 'bullish' WHEN s < -0.15 THEN 'bearish' ELSE 'neutral' END"

ORACLES: dict[str, str] = {
    "bars_load": _with(TICKS, _ohlc("bars", "15m", "time_bucket(INTERVAL '15 minutes', ts)"), select=f"SELECT {KEYS}, ts, {OHLC} FROM bars"),
    "macro_daily": _with(MACRO, select=f"SELECT day, {_r('dxy', 'vix', 'tnx')} FROM macro0"),
    "trade_log_valid": "SELECT event_id, round(value / 100, 6) AS tier_a_prob, event_type AS tier_b_bias FROM events WHERE value / 100 BETWEEN 0 AND 1",
    "source_fallback": _with(DAILY, """lt AS (SELECT CASE WHEN l_returnflag = 'A' THEN '1-URGENT' ELSE l_returnflag END AS symbol, CAST(l_shipdate AS DATE) AS day, l_extendedprice / l_quantity AS price FROM lineitem),
u AS (SELECT symbol, 2 AS rank, ts::DATE AS day, low, high FROM daily UNION ALL SELECT symbol, 1, day, min(price), max(price) FROM lt GROUP BY symbol, day)""", select="SELECT symbol, rank, count(*) AS n, round(min(low), 6) AS low, round(max(high), 6) AS high FROM (SELECT *, min(rank) OVER (PARTITION BY symbol) AS best FROM u) WHERE rank = best GROUP BY symbol, rank"),
    "catalog_defaulting": _with(_TABLES, "e AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'BTCUSD' ELSE event_type END AS s, CASE WHEN event_id % 2 = 0 THEN '1H' ELSE '2H' END AS t FROM events)", select="SELECT coalesce(sy.id, 'XAUUSD') AS symbol, coalesce(tf.id, '1D') AS timeframe, count(*) AS n FROM e LEFT JOIN sy ON sy.id = s LEFT JOIN tf ON tf.id = t GROUP BY 1, 2"),
    "pairs_available": _with(_TABLES, select=f"SELECT DISTINCT sy.id AS symbol, tf.id AS timeframe FROM sy, tf WHERE EXISTS (SELECT 1 FROM events WHERE ['XAUUSD', 'BTCUSD', 'ETHUSD', 'SPX500', 'NAS100'][user_id % 5 + 1] = sy.id AND ['1m', '5m', '15m', '1H', '4H', '1D', '1W'][user_id % 4 + 1] = tf.id)"),
    "bars_dedupe_last": _with(TICKS, select="SELECT symbol, '1H' AS timeframe, date_trunc('hour', ts) AS ts, round(arg_max(price, event_id), 6) AS close, max(event_id) AS event_id FROM ticks GROUP BY symbol, date_trunc('hour', ts)"),
    "tail_per_series": _with(BARS, select=f"SELECT {KEYS}, ts, {OHLC} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100"),
    "macro_fill": _with(MACRO, "g AS (SELECT day, dxy, CASE WHEN dayofyear(day) % 3 <> 0 THEN vix END AS vix, CASE WHEN dayofyear(day) % 4 <> 0 THEN tnx END AS tnx FROM macro0)", select=f"SELECT day, round(dxy, 6) AS dxy, round({_filled('vix', 'ORDER BY day')}, 6) AS vix, round({_filled('tnx', 'ORDER BY day')}, 6) AS tnx FROM g"),
    "bars_resample_4h": _with(BARS, _coarser("f", "4H", "4 hours"), select=f"SELECT {KEYS}, ts, {OHLC} FROM f"),
    "bars_resample_1d": _with(BARS, _coarser("f", "1D", "1 day"), select=f"SELECT {KEYS}, ts, {OHLC} FROM f"),
    "bars_from_ticks_1h": _with(BARS, select=f"SELECT {KEYS}, ts, {OHLC} FROM bars"),
    "cross_tf_daily": _with(BARS, _coarser("f", "4H", "4 hours"), _coarser("dd", "1D", "1 day"), _pos(), _averages(), _pos("f", "b4"), _averages("b4", "ind4"), *(f"d{n} AS (SELECT symbol, CAST(ts AS DATE) AS day, arg_max(rsi, ts) AS rsi, arg_max(CAST(sign(e20 - e50) AS DOUBLE), ts) AS x FROM {s} GROUP BY ALL)" for n, s in (("1", "ind"), ("4", "ind4"))), select="SELECT dd.symbol, dd.ts, round(close, 6) AS close, round(d1.rsi, 6) AS rsi_1h, d1.x AS ema_cross_1h, round(d4.rsi, 6) AS rsi_4h, d4.x AS ema_cross_4h FROM dd LEFT JOIN d1 ON d1.symbol = dd.symbol AND d1.day = dd.ts::DATE LEFT JOIN d4 ON d4.symbol = dd.symbol AND d4.day = dd.ts::DATE"),
    "macro_attach": _with(DAILY, MACRO, "j AS (SELECT daily.*, m.dxy AS x, m.vix AS y, m.tnx AS z FROM daily LEFT JOIN macro0 m ON m.day = ts::DATE)", f"k AS (SELECT *, {_filled('x', 'PARTITION BY symbol ORDER BY ts')} AS dxy, {_filled('y', 'PARTITION BY symbol ORDER BY ts')} AS vix, {_filled('z', 'PARTITION BY symbol ORDER BY ts')} AS tnx FROM j)", select=_attached("k")),
    "macro_asof": _with(DAILY, MACRO, "m AS (SELECT CAST(day AS TIMESTAMP) AS mts, dxy, vix, tnx FROM macro0)", "k AS (SELECT * FROM daily ASOF LEFT JOIN m ON daily.ts >= m.mts)", select=_attached("k")),
    "ema_20": _with(*IND, select=f"SELECT {KEYS}, ts, round(e20, 6) AS ema_20 FROM ind"),
    "ema_50": _with(*IND, select=f"SELECT {KEYS}, ts, round(e50, 6) AS ema_50 FROM ind"),
    "rsi_14": _with(*IND, select=f"SELECT {KEYS}, ts, {_r('rsi')} FROM ind"),
    "true_range": _with(BARS, _pos(), select=f"SELECT {KEYS}, ts, {_r('tr')} FROM b"),
    "atr_14": _with(*IND, select=f"SELECT {KEYS}, ts, {_r('atr')} FROM ind"),
    "atr_sma_200": _with(BARS, _pos(), select=f"SELECT {KEYS}, ts, round(avg(tr) OVER (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 6) AS atr_long FROM b"),
    "macd": _with(*IND, select=f"SELECT {KEYS}, ts, round(e12 - e26, 6) AS macd, round(sig, 6) AS macd_signal FROM ind"),
    "bollinger": _with(BARS, f"bb AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w END AS mid, stddev_pop(close) OVER w AS sd FROM bars WINDOW w AS ({_B20}))", select=f"SELECT {KEYS}, ts, round(mid, 6) AS bb_mid, round(mid + 2 * sd, 6) AS bb_upper, round(mid - 2 * sd, 6) AS bb_lower, round((close - (mid - 2 * sd)) / nullif((mid + 2 * sd) - (mid - 2 * sd), 0), 6) AS bb_pct FROM bb"),
    "trend_bias": _with(*IND, _bias("tbias", "ind"), select=f"SELECT {KEYS}, bias, CASE bias WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END AS code FROM tbias"),
    "mtf_confluence": _with(BARS, _coarser("f", "4H", "4 hours"), _coarser("dd", "1D", "1 day"), "un AS (SELECT * FROM bars UNION ALL BY NAME SELECT * FROM f UNION ALL BY NAME SELECT * FROM dd)", _pos("un"), _averages(), _bias("tbias", "ind"), "v AS (SELECT symbol, count(*) FILTER (WHERE bias = 'bullish') AS bullish, count(*) FILTER (WHERE bias = 'bearish') AS bearish, count(*) FILTER (WHERE bias = 'neutral') AS neutral, count(*) AS n FROM tbias GROUP BY symbol)", select="SELECT symbol, bullish, bearish, neutral, CASE WHEN bullish > bearish AND bullish > neutral THEN 'bullish' WHEN bearish > bullish AND bearish > neutral THEN 'bearish' ELSE 'neutral' END AS bias, greatest(bullish, bearish, neutral) = n AS confluence FROM v"),
    "log_returns": _with(BARS, _pos(), select=f"SELECT {KEYS}, ts, round(ln(close) - ln(pc), 6) AS ret_1, round(ln(close) - ln(lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts)), 6) AS ret_5 FROM b"),
    "entropy_20": _with(BARS, _pos(), ENTROPY.format(source="b"), select=f"SELECT {KEYS}, ts, {_r('entropy_20')} FROM ent"),
    "swings_fractal": _with(BARS, _pos(), SWINGS.format(source="b"), select=f"SELECT {KEYS}, pos, ts, round(swing_high, 6) AS price, 'high' AS kind FROM sw WHERE swing_high IS NOT NULL UNION ALL SELECT {KEYS}, pos, ts, round(swing_low, 6), 'low' FROM sw WHERE swing_low IS NOT NULL"),
    "structure_bias": _with(BARS, _pos(), SWINGS.format(source="b"), "l AS (SELECT symbol, timeframe, arg_max(close, pos) AS c, list(swing_high ORDER BY pos) FILTER (WHERE swing_high IS NOT NULL) AS h, list(swing_low ORDER BY pos) FILTER (WHERE swing_low IS NOT NULL) AS w FROM sw GROUP BY ALL)", select=f"SELECT {KEYS}, CASE WHEN len(h) >= 2 AND c > h[len(h) - 1] THEN 1 WHEN len(w) >= 2 AND c < w[len(w) - 1] THEN -1 ELSE 0 END AS bias FROM l"),
    "order_blocks_basic": _with(BARS, _pos(), "o AS (SELECT *, abs(close - open) AS body, lag(abs(close - open)) OVER (PARTITION BY symbol ORDER BY ts) AS last FROM b)", select=f"SELECT {KEYS}, pos - 1 AS at, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS kind, round(ph, 6) AS top, round(pl, 6) AS bottom FROM o WHERE last > 0 AND body >= 1.6 * last QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos) <= 3"),
    "fvg_basic": _with(BARS, _pos(), "o AS (SELECT *, lead(high) OVER (PARTITION BY symbol ORDER BY ts) AS nh, lead(low) OVER (PARTITION BY symbol ORDER BY ts) AS nl FROM b)", "q AS (SELECT *, CASE WHEN ph < nl THEN 'bullish' WHEN pl > nh THEN 'bearish' END AS kind, CASE WHEN ph < nl THEN nl ELSE pl END AS top, CASE WHEN ph < nl THEN ph ELSE nh END AS bottom FROM o)", select=f"SELECT {KEYS}, pos, kind, round((top + bottom) / 2, 6) AS price, {_r('top', 'bottom')} FROM q WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos) <= 10"),
    "smc_bias_rolling": _with(BARS, _pos(), SWINGS.format(source="b"), ROLLING, select=f"SELECT {KEYS}, ts, smc_bias FROM roll"),
    "sr_zones": _with(BARS, _pos(), SWINGS.format(source="b"), f"l AS (SELECT symbol, timeframe, {_zones(_points('list(swing_high) FILTER (WHERE swing_high IS NOT NULL)', 'list(swing_low) FILTER (WHERE swing_low IS NOT NULL)'))} AS zl FROM sw GROUP BY symbol, timeframe)", "u AS (SELECT symbol, timeframe, unnest(zl) AS z, CAST(generate_subscripts(zl, 1) - 1 AS INTEGER) AS zone FROM l)", select=f"SELECT {KEYS}, zone, round(z.total / z.n, 6) AS price, round(z.tail, 6) AS top, round(z.head, 6) AS bottom, CASE WHEN z.low * 2 >= z.n THEN 'support' ELSE 'resistance' END AS kind, z.n AS touches FROM u"),
    "nearest_zone": _with(BARS, _pos(), SWINGS.format(source="b"), ROLLING, select=f"SELECT {KEYS}, ts, round(near.price, 6) AS zone_price, near.kind AS zone_kind, near.touches AS touches, round(near.d / close * 100, 6) AS distance_pct FROM roll WHERE near IS NOT NULL"),
    "zone_distance": _with(*IND, SWINGS.format(source="ind"), ROLLING, select=f"SELECT {KEYS}, ts, round(CASE WHEN atr > 0 THEN near.d / atr END, 6) AS zone_dist_atr, CASE WHEN near.d / atr < 0.5 THEN 1 ELSE 0 END AS at_zone FROM roll"),
    "legs": _with(BARS, _pos(), _INNER, select=f"SELECT {KEYS}, pos, leg FROM leg"),
    "pivots": _with(BARS, _pos(), _SWING, select=f"SELECT {KEYS}, pos, confirmed, round(price, 6) AS price, kind, CASE WHEN kind = 'high' THEN CASE WHEN last IS NULL OR price > last THEN 'HH' ELSE 'LH' END ELSE CASE WHEN last IS NULL OR price < last THEN 'LL' ELSE 'HL' END END AS label FROM pvl"),
    "equal_hl": _with(BARS, _pos(), _SWING, select=f"SELECT {KEYS}, CASE WHEN kind = 'high' THEN 'EQH' ELSE 'EQL' END AS kind, pos AS x, round(price, 6) AS price, round(last, 6) AS prev_price FROM pvl WHERE az > 0 AND abs(price - last) <= 0.1 * az"),
    "structure_breaks": _with(BARS, _pos(), _INNER, BREAKS.format(z=4), select=f"SELECT {KEYS}, pos, pivot_pos, round(level, 6) AS level, side, tag FROM br"),
    "order_blocks": _with(BARS, _pos(), _INNER, BREAKS.format(z=4), BLOCKS, select=f"SELECT {KEYS}, x, side, break_pos, {_r('top', 'bottom')} FROM mit WHERE mitigated IS NULL QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY break_pos DESC, side) <= 12"),
    "fvg": _with(BARS, _pos(), GAPS.format(source="b"), select=f"SELECT {KEYS}, x, side, {_r('top', 'bottom')} FROM gaps g WHERE NOT EXISTS (SELECT 1 FROM b p WHERE p.symbol = g.symbol AND p.pos > g.x AND CASE WHEN g.side = 'bull' THEN p.low < g.bottom ELSE p.high > g.top END) QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY x DESC, side) <= 20"),
    "ob_mitigation": _with(BARS, _pos(), _INNER, BREAKS.format(z=4), BLOCKS, select=f"SELECT {KEYS}, side, break_pos, x, {_r('top', 'bottom')}, mitigated FROM mit"),
    "premium_discount": _with(BARS, _pos(), _SWING, _LAST, select=f"SELECT {KEYS}, {_r('top', 'bottom')}, round((top + bottom) / 2, 6) AS equilibrium, round(0.95 * top + 0.05 * bottom, 6) AS premium_low, round(0.95 * bottom + 0.05 * top, 6) AS discount_high FROM lv"),
    "smc_summary": _with(BARS, _pos(), _SWING, BREAKS.format(z=10), _LAST, "lb AS (SELECT symbol, timeframe, arg_max(side, pos * 2 + CASE WHEN side = 'bull' THEN 0 ELSE 1 END) AS side FROM br GROUP BY ALL)", select=f"SELECT {KEYS}, coalesce(side, 'neutral') AS bias, round(top, 6) AS top, top_bar, round(bottom, 6) AS bottom, bottom_bar FROM lv LEFT JOIN lb USING (symbol, timeframe)"),
    "volume_spike": _with(BARS, _pos(), SUPPLY, select=f"SELECT {KEYS}, ts, spike FROM sd1"),
    "sd_candidates": _with(BARS, _pos(), SUPPLY, select=f"SELECT {KEYS}, kind, x1, x2, {_r('top', 'bottom', 'delta')} FROM cand"),
    "sd_cooldown": _with(BARS, _pos(), SUPPLY, COOLED, select=f"SELECT {KEYS}, kind, x1, x2 FROM cool"),
    "supply_demand": _with(BARS, _pos(), SUPPLY, COOLED, select=f"SELECT {KEYS}, x2, kind, x1, {_r('top', 'bottom', 'delta', 'side_total')}, coalesce(round(abs(delta) / nullif(every, 0) * 100, 1), 0) AS pct FROM latest"),
    "order_flow": _with(BARS, _pos(), SUPPLY, COOLED, "z AS (SELECT symbol, timeframe, coalesce(sum(abs(delta)) FILTER (WHERE kind = 'supply'), 0) AS supply, coalesce(sum(abs(delta)) FILTER (WHERE kind = 'demand'), 0) AS demand FROM latest GROUP BY ALL)", "y AS (SELECT *, coalesce((demand - supply) / nullif(demand + supply, 0), 0) AS score FROM z)", select=f"SELECT {KEYS}, {_r('supply', 'demand', 'score')}, CASE WHEN score > 0.15 THEN 'Bullish' WHEN score < -0.15 THEN 'Bearish' ELSE 'Neutral' END AS sentiment FROM y"),
    "volume_profile_bins": _with(BARS, PROFILE, select=f"SELECT {KEYS}, day, bin, {_r('center', 'volume')} FROM vbins"),
    "vp_poc": _with(BARS, PROFILE, select="SELECT p.symbol, p.timeframe, p.day, round(v.center, 6) AS poc_price FROM poc p JOIN vbins v ON v.symbol = p.symbol AND v.day = p.day AND v.bin = p.p"),
    "vp_value_area": _with(BARS, PROFILE, select="SELECT p.symbol, p.timeframe, p.day, round(v.center, 6) AS poc_price, round(l.center, 6) AS va_low, round(h.center, 6) AS va_high FROM poc p JOIN area a USING (symbol, timeframe, day) JOIN vbins v ON v.symbol = p.symbol AND v.day = p.day AND v.bin = p.p JOIN vbins l ON l.symbol = p.symbol AND l.day = p.day AND l.bin = a.lo_i JOIN vbins h ON h.symbol = p.symbol AND h.day = p.day AND h.bin = a.hi_i"),
    "feature_matrix": _with(MATRIX, select=f"SELECT {_FM} FROM fm"),
    "features_last_row_exact": _with(MATRIX, select=f"SELECT {_FM} FROM fm QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) = 1"),
    "features_last_row": _with(_M200, select=f"SELECT {_FM} FROM fm QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) = 1"),
    "feature_matrix_deduped": _with(MATRIX, select=f"SELECT {_FM} FROM fm"),
    "feature_matrix_macro": _with(
        MATRIX.replace(BARS, DAILY.replace("daily AS (", "bars AS (")).replace("fm AS (", "fm_plain AS ("),
        MACRO,
        "mj AS (SELECT bars.symbol, bars.timeframe, bars.ts, m.dxy AS x, m.vix AS y, m.tnx AS z FROM bars LEFT JOIN macro0 m ON m.day = ts::DATE)",
        f"mk AS (SELECT symbol, timeframe, ts, {_filled('x', 'PARTITION BY symbol ORDER BY ts')} AS dxy, {_filled('y', 'PARTITION BY symbol ORDER BY ts')} AS vix, {_filled('z', 'PARTITION BY symbol ORDER BY ts')} AS tnx FROM mj)",
        "ml AS (SELECT symbol, timeframe, ts, ln(dxy / lag(dxy) OVER (PARTITION BY symbol ORDER BY ts)) AS dxy_return_1d, least(vix / 50, 1) AS vix_level, tnx / 10 AS tnx_level FROM mk)",
        select=f"SELECT {_FM}, {_r('dxy_return_1d', 'vix_level', 'tnx_level')} FROM fm_plain JOIN ml USING (symbol, timeframe, ts) WHERE dxy_return_1d IS NOT NULL AND vix_level IS NOT NULL AND tnx_level IS NOT NULL",
    ),
    "macro_join": _with(
        "j AS (SELECT day, dxy, vix, tnx FROM (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_extendedprice) AS dxy FROM lineitem GROUP BY 1) LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) / 10000 AS vix FROM orders GROUP BY 1) USING (day) LEFT JOIN (SELECT CAST(l_shipdate AS DATE) AS day, 100 * avg(l_tax) AS tnx FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) USING (day))",
        select=f"SELECT day, round(dxy, 6) AS dxy, round({_filled('vix', 'ORDER BY day')}, 6) AS vix, round({_filled('tnx', 'ORDER BY day')}, 6) AS tnx FROM j",
    ),
    "legs_swing": _with(BARS, _pos(), _SWING, select=f"SELECT {KEYS}, pos, leg FROM leg"),
    "structure_breaks_swing": _with(BARS, _pos(), _SWING, BREAKS.format(z=10), select=f"SELECT {KEYS}, pos, pivot_pos, round(level, 6) AS level, side, tag FROM br"),
    "order_blocks_swing": _with(BARS, _pos(), _SWING, BREAKS.format(z=10), BLOCKS, select=f"SELECT {KEYS}, x, side, break_pos, {_r('top', 'bottom')} FROM mit WHERE mitigated IS NULL QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY break_pos DESC, side) <= 12"),
    "ob_mitigation_swing": _with(BARS, _pos(), _SWING, BREAKS.format(z=10), BLOCKS, select=f"SELECT {KEYS}, side, break_pos, x, {_r('top', 'bottom')}, mitigated FROM mit"),
    "vif": _with(
        MATRIX,
        "g AS (SELECT symbol, timeframe, [" + ", ".join("[" + ", ".join([f"sum(CAST({a} AS DOUBLE) * {b} ORDER BY symbol, ts)" for b in NAMES] + [f"CAST({int(i == j)} AS DOUBLE)" for j in range(len(NAMES))]) + "]" for i, a in enumerate(NAMES)) + "] AS m FROM fm GROUP BY symbol, timeframe)",
        _gauss(len(NAMES)),
        select=" UNION ALL ".join(f"SELECT symbol, timeframe, '{c}' AS feature, round(g.m[{i + 1}][{i + 1}] * inv.m[{i + 1}][{len(NAMES) + i + 1}], 6) AS vif, g.m[{i + 1}][{i + 1}] * inv.m[{i + 1}][{len(NAMES) + i + 1}] > 10 AS high FROM g JOIN inv USING (symbol, timeframe)" for i, c in enumerate(NAMES)),
    ),
    "chart_overlays": _with(
        *_CHART,
        select=f"SELECT {KEYS}, overlay, tag, side, greatest(x1 - shift, 0) AS x1, greatest(x2 - shift, 0) AS x2, {_r('top', 'bottom')} FROM ov JOIN sz USING (symbol, timeframe) WHERE greatest(x1, x2) >= shift UNION ALL "
        + " UNION ALL ".join(f"SELECT {KEYS}, 'level', '{k}', coalesce(side, 'neutral'), greatest({k}_bar - shift, 0), greatest({k}_bar - shift, 0), round({k}, 6), round({k}, 6) FROM lv LEFT JOIN lb USING (symbol, timeframe) JOIN sz USING (symbol, timeframe)" for k in ("top", "bottom")),
    ),
    "reading": _with(
        LABELED,
        CONFORMAL,
        _renamed(_M200 + ",\n" + _PRED, "_p"),
        _renamed(",\n".join(_TIERB), "_t"),
        _NEWS,
        "ng AS (SELECT symbol, coalesce(avg(score), 0) AS s, count(*) AS news_count FROM recent GROUP BY symbol)",
        select=f"""SELECT p.symbol, p.timeframe, p.ts AS asof, round(t.price, 2) AS price, 10 AS horizon_bars, round(p.proba, 4) AS probability, CASE WHEN p.proba >= 0.5 THEN 'LONG' ELSE 'SHORT' END AS direction, t.bias, t.zone_price, t.at_zone,
  coalesce(news_count, 0) AS count, coalesce(round(s, 4), 0) AS score, coalesce({_TAG}, 'neutral') AS tag, round(least(greatest((p.proba * 2 - (1 - p.proba)) / 2, 0) / 2, 0.02) * 100, 3) AS final_pct, round(p.atr_pct, 4) AS atr_pct
FROM pred_p p JOIN tier_t t ON t.symbol = p.symbol AND t.timeframe = p.timeframe LEFT JOIN ng ON ng.symbol = p.symbol""",
    ),
    "stream_bars": _with(BARS, select=f"SELECT {KEYS}, ts, {OHLC} FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 2 HOUR"),
    "stream_ema": _with(*IND, select=f"SELECT {KEYS}, ts, pos, round(e20, 6) AS ema, {_r('rsi', 'atr')} FROM ind"),
    "stream_reading": _with(_M200, _PRED, select=f"SELECT {KEYS}, ts, {_r('close', 'proba')} FROM pred"),
    "triple_barrier": _with(LABELED, select=f"SELECT {KEYS}, ts, {_r('close', 'atr_pct')}, label, label_bars FROM sc"),
    "label_balance": _with(LABELED, select=f"SELECT {KEYS}, count(*) AS n, round(avg(label), 6) AS positive_rate, round(avg(label_bars), 6) AS mean_bars FROM sc GROUP BY ALL"),
    "feature_corr": _with(MATRIX, select=" UNION ALL ".join(f"SELECT symbol, timeframe, '{a}' AS a, '{b}' AS b, coalesce(round(corr({a}, {b}), 3), 0) AS r FROM fm GROUP BY symbol, timeframe" for a in NAMES for b in NAMES)),
    "high_corr_pairs": _with(MATRIX, "cc AS (" + " UNION ALL ".join(f"SELECT symbol, timeframe, '{a}' AS a, '{b}' AS b, coalesce(round(corr({a}, {b}), 3), 0) AS r FROM fm GROUP BY symbol, timeframe" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]) + ")", select="SELECT * FROM cc WHERE abs(r) > 0.25"),
    "time_series_folds": _with(LABELED, "t AS (SELECT symbol, timeframe, fold, count(*) AS n_test, min(ts) AS test_from, max(ts) AS test_to FROM sc GROUP BY ALL)", select=f"SELECT * FROM (SELECT {KEYS}, fold, n_test, test_from, test_to, CAST(coalesce(sum(n_test) OVER (PARTITION BY symbol, timeframe ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_train FROM t) WHERE fold > 0"),
    "standardize": _with(LABELED, "st AS (SELECT a.symbol, a.timeframe, k.f AS fold, " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("rsi", "atr_pct", "ret_1")) + " FROM sc a, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS f) k WHERE a.fold < k.f GROUP BY ALL)", select=f"SELECT sc.symbol, sc.timeframe, ts, sc.fold, " + ", ".join(f"round(({c} - m_{c}) / coalesce(nullif(s_{c}, 0), 1), 6) AS {c}" for c in ("rsi", "atr_pct", "ret_1")) + " FROM sc JOIN st USING (symbol, timeframe, fold)"),
    "training_gate": _with(LABELED, _TABLES, select="SELECT symbol, timeframe, count(label) AS n, CAST(min(min_bars) AS INTEGER) AS min_bars, count(label) >= min(min_bars) AS trained FROM sc JOIN tf ON tf.id = timeframe GROUP BY symbol, timeframe"),
    "brier_skill": _with(LABELED, _SKILL, select=f"SELECT {KEYS}, {_r('fold_brier', 'brier', 'reference', 'skill')} FROM bs"),
    "roc_auc": _with(LABELED, _AUC, select=f"SELECT {KEYS}, {_r('auc')} FROM au"),
    "reliability": _with(LABELED, select=f"SELECT {KEYS}, CAST(greatest(least(ceil(proba * 10) - 1, 9), 0) AS INTEGER) AS bin, count(*) AS n, round(avg(proba), 6) AS mean_proba, round(avg(label), 6) AS positive_rate FROM sc WHERE fold > 0 GROUP BY ALL"),
    "conformal_qhat": _with(LABELED, CONFORMAL, select=f"SELECT {KEYS}, {_r('q_hat')}, alpha, n_cal, coverage FROM cq"),
    "threshold_taken": _with(LABELED, EQUITY, select=f"SELECT {KEYS}, ts, {_r('proba', 'threshold')}, taken FROM eq"),
    "equity_curve": _with(LABELED, EQUITY, select=f"SELECT {KEYS}, ts, pnl_r, equity_r, round(equity_r * 0.02, 6) AS equity_pct FROM eq"),
    "backtest_metrics": _with(LABELED, EQUITY, METRICS, select="SELECT * EXCLUDE (last_proba) FROM m"),
    "kpis": _with(
        LABELED,
        EQUITY,
        METRICS,
        _TODAY,
        select=" UNION ALL ".join(
            f"SELECT {KEYS}, '{i}' AS id, CAST({v} AS DOUBLE) AS value, CAST({t} AS VARCHAR) AS text, CAST({c} AS DOUBLE) AS change, CAST({u} AS BOOLEAN) AS up FROM m JOIN td USING (symbol, timeframe)"
            for i, v, t, c, u in [
                ("total_profit", "total_profit_r", "NULL", "round(today_r, 2)", "today_r >= 0"),
                ("win_rate", "round(win_rate * 100, 2)", "NULL", "0", "NULL"),
                ("current_position", "NULL", "CASE WHEN last_proba >= 0.5 THEN 'LONG' ELSE 'SHORT' END", "0", "last_proba >= 0.5"),
                ("ai_confidence", "round(last_proba * 100, 1)", "NULL", "round((last_proba - 0.5) * 100, 1)", "last_proba >= 0.5"),
                ("prediction", "NULL", "CASE WHEN last_proba >= 0.5 THEN 'BULLISH' ELSE 'BEARISH' END", "0", "last_proba >= 0.5"),
                ("today_profit", "round(today_r, 2)", "NULL", "0", "today_r >= 0"),
                ("sharpe", "sharpe", "NULL", "0", "sharpe > 0"),
                ("max_dd", "max_drawdown_r", "NULL", "0", "false"),
                ("expected_value", "round(win_rate * 2 - (1 - win_rate), 3)", "NULL", "0", "round(win_rate * 2 - (1 - win_rate), 3) > 0"),
                ("probability_score", "round(last_proba * 100, 1)", "NULL", "round((last_proba - 0.5) * 100, 1)", "last_proba >= 0.5"),
            ]
        ),
    ),
    "kpis_live": _with(
        LABELED,
        EQUITY,
        METRICS,
        _TODAY,
        _renamed(_M200 + ",\n" + _PRED, "_p"),
        select=" UNION ALL ".join(
            f"SELECT {KEYS}, '{i}' AS id, CAST({v} AS DOUBLE) AS value, CAST({t} AS VARCHAR) AS text, CAST({c} AS DOUBLE) AS change, CAST({u} AS BOOLEAN) AS up FROM m JOIN td USING (symbol, timeframe) LEFT JOIN (SELECT symbol, timeframe, proba AS lp FROM pred_p) USING (symbol, timeframe)"
            for i, v, t, c, u in [
                ("total_profit", "total_profit_r", "NULL", "round(today_r, 2)", "today_r >= 0"),
                ("win_rate", "round(win_rate * 100, 2)", "NULL", "0", "NULL"),
                ("current_position", "NULL", "CASE WHEN last_proba >= 0.5 THEN 'LONG' ELSE 'SHORT' END", "0", "last_proba >= 0.5"),
                ("ai_confidence", "round(round(lp, 4) * 100, 1)", "NULL", "round((last_proba - 0.5) * 100, 1)", "last_proba >= 0.5"),
                ("prediction", "NULL", "CASE WHEN last_proba >= 0.5 THEN 'BULLISH' ELSE 'BEARISH' END", "0", "last_proba >= 0.5"),
                ("today_profit", "round(today_r, 2)", "NULL", "0", "today_r >= 0"),
                ("sharpe", "sharpe", "NULL", "0", "sharpe > 0"),
                ("max_dd", "max_drawdown_r", "NULL", "0", "false"),
                ("expected_value", "round(win_rate * 2 - (1 - win_rate), 3)", "NULL", "0", "round(win_rate * 2 - (1 - win_rate), 3) > 0"),
                ("probability_score", "round(round(lp, 4) * 100, 1)", "NULL", "round((last_proba - 0.5) * 100, 1)", "last_proba >= 0.5"),
            ]
        ),
    ),
    "kpi_sparklines": _with(
        LABELED,
        EQUITY,
        "sl AS (SELECT symbol, timeframe, equity_r, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) AS rn, count(*) OVER (PARTITION BY symbol, timeframe) AS n FROM eq)",
        select=f"SELECT {KEYS}, id, CAST(least(n, size) - rn AS INTEGER) AS i, equity_r FROM sl JOIN (VALUES ('total_profit', 30), ('win_rate', 30), ('ai_confidence', 30), ('probability_score', 30), ('today_profit', 7)) AS v(id, size) ON rn <= size",
    ),
    "market_sparklines": _with(
        BARS,
        "sl AS (SELECT symbol, timeframe, close, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) AS rn, count(*) OVER (PARTITION BY symbol, timeframe) AS n FROM bars)",
        select=f"SELECT {KEYS}, CAST(least(n, 30) - rn AS INTEGER) AS i, round(close, 2) AS close FROM sl WHERE rn <= 30",
    ),
    "asof_ticks": _with(TICKS, _ohlc("bars", "15m", "time_bucket(INTERVAL '15 minutes', ts)"), HEADS, _MATCHED, "n AS (SELECT symbol, published_at, max(doc_id) AS doc_id, arg_max(struct_pack(s := score), doc_id).s AS score FROM matched GROUP BY 1, 2)", select=f"SELECT b.symbol, b.timeframe, b.ts, round(b.close, 6) AS close, n.doc_id, n.score, n.published_at, CAST(epoch(b.ts) - epoch(n.published_at) AS BIGINT) AS age FROM bars b ASOF LEFT JOIN n ON b.symbol = n.symbol AND b.ts >= n.published_at"),
    "asof_quotes": _with(TICKS, HEADS, _MATCHED, "q AS (SELECT symbol, ts, arg_max(price, event_id) AS price FROM ticks GROUP BY 1, 2)", "k AS (SELECT m.symbol, m.doc_id, m.published_at, q.price, q.ts AS qts, q.ts >= m.published_at - INTERVAL 10 MINUTE AS fresh FROM matched m ASOF LEFT JOIN q ON m.symbol = q.symbol AND m.published_at >= q.ts)", select="SELECT symbol, doc_id, published_at, CASE WHEN fresh THEN round(price, 6) END AS price, CASE WHEN fresh THEN qts END AS quoted_at FROM k"),
    "headlines_matched": _with(HEADS, _MATCHED, select="SELECT symbol, doc_id, title, published_at, score FROM matched"),
    "news_overlay_matched": _with(
        HEADS,
        _MATCHED,
        "hit AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, doc_id) AS n FROM matched WHERE published_at >= (SELECT max(published_at) FROM matched) - INTERVAL 72 HOUR QUALIFY n <= 20)",
        "g AS (SELECT symbol, coalesce(avg(score), 0) AS s, count(*) AS news_count FROM hit GROUP BY symbol)",
        select=f"SELECT symbol, round(s, 4) AS news_score, news_count, {_TAG} AS tag FROM g",
    ),
    "probability_hist": _with(LABELED, "h AS (SELECT symbol, timeframe, CAST(greatest(least(floor(proba * 20), 19), 0) AS INTEGER) AS bin, count(*) AS c FROM sc GROUP BY ALL)", "g AS (SELECT k.symbol, k.timeframe, r.bin, coalesce(h.c, 0) AS n FROM (SELECT DISTINCT symbol, timeframe FROM h) k CROSS JOIN (SELECT CAST(unnest(range(20)) AS INTEGER) AS bin) r LEFT JOIN h USING (symbol, timeframe, bin))", select=f"SELECT {KEYS}, bin, n, round(sum(n) OVER (PARTITION BY symbol, timeframe ORDER BY bin) / sum(n) OVER (PARTITION BY symbol, timeframe) * 100, 6) AS cumulative_pct FROM g"),
    "probability_stats": _with(LABELED, select=f"SELECT {KEYS}, " + ", ".join(f"round(quantile_cont(proba, {q}), 3) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", round(arg_max(proba, ts), 4) AS current, round(avg(proba), 4) AS mean, round(stddev_pop(proba), 4) AS std FROM sc GROUP BY ALL"),
    "trades_recent": _with(LABELED, EQUITY, "t AS (SELECT *, CAST(row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) AS INTEGER) AS rn FROM eq WHERE taken = 1)", select=f"SELECT {KEYS}, rn AS n, ts, round(close, 2) AS entry, round(close * (1 + pnl_r * atr_pct / 100 / 2), 2) AS exit, pnl_r AS pnl, CASE WHEN label = 1 THEN 'TP' ELSE 'SL' END AS status, label_bars, round(proba, 3) AS confidence FROM t WHERE rn <= 50"),
    "confidence_gauges": _with(
        LABELED,
        EQUITY,
        METRICS,
        "s AS (SELECT *, round(greatest(1 - brier_score, 0) * 100, 1) AS conf FROM m)",
        select=" UNION ALL ".join(
            f"SELECT {KEYS}, '{g}' AS gauge, {v} AS value, {t} AS top FROM s"
            for g, v, t in [("Confidence", "conf", 100), ("Risk", "round(100 - conf, 1)", 100), ("Probability", "round(last_proba * 100, 1)", 100), ("Expected Profit", "round(greatest(total_profit_r, 0), 1)", 50), ("Sharpe", "round(greatest(sharpe, 0) * 25, 1)", 100), ("Sortino", "round(greatest(sortino, 0) * 25, 1)", 100), ("Calmar", "round(greatest(calmar, 0) * 40, 1)", 100)]
        ),
    ),
    "insight_flags": _with(LABELED, _SKILL, _AUC, "la AS (SELECT *, median(proba) OVER (PARTITION BY symbol, timeframe) AS med FROM sc QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) = 1)", select="""SELECT la.symbol, la.timeframe, CASE WHEN proba >= 0.5 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN skill >= 0.10 THEN 'edge' WHEN skill >= 0 THEN 'weak' ELSE 'none' END AS skill_tag,
  CASE WHEN auc >= 0.55 THEN 'useful' WHEN auc >= 0.60 THEN 'clear edge' ELSE 'near-random' END AS auc_tag, CASE WHEN entropy_20 > 0.8 THEN 'noise' WHEN entropy_20 < 0.6 THEN 'structured' ELSE 'mixed' END AS regime,
  atr_pct > 1.5 AS elevated, rsi > 0.7 AS overbought, CASE WHEN smc_bias > 0 THEN 'bullish' WHEN smc_bias < 0 THEN 'bearish' ELSE 'neutral' END AS structure, at_zone = 1 AS at_zone, proba > med AS above_median,
  round(greatest((proba * 2 - (1 - proba)) / 2, 0) * 100, 3) AS kelly_pct FROM la LEFT JOIN bs USING (symbol, timeframe) LEFT JOIN au USING (symbol, timeframe)"""),
    "chart_window": _with(BARS, "ctx AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) <= 350)", _pos("ctx", "cb"), GAPS.format(source="cb"), "sz AS (SELECT symbol, timeframe, greatest(least(count(*), 350) - 150, 0) AS shift FROM bars GROUP BY ALL HAVING count(*) >= 30)", select=f"SELECT {KEYS}, side, greatest(x - shift, 0) AS x, {_r('top', 'bottom')}, greatest(x + 1 - shift, 0) AS x2 FROM gaps JOIN sz USING (symbol, timeframe) WHERE x + 1 - shift >= 0"),
    "equity_extremes": _with(LABELED, EQUITY, "e AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts) - 1 AS p FROM eq)", select=f"SELECT {KEYS}, CAST(arg_min(p, {{'v': equity_r, 'p': p}}) AS INTEGER) AS min_pos, min(equity_r) AS min_r, CAST(arg_min(p, {{'v': -equity_r, 'p': p}}) AS INTEGER) AS max_pos, max(equity_r) AS max_r, arg_max(equity_r, p) AS last, arg_max(equity_r, p) - 2 AS band_low, arg_max(equity_r, p) + 2 AS band_high FROM e GROUP BY ALL"),
    "heuristic_proba": _with(_M200, _PRED, select=f"SELECT {KEYS}, ts, {_r('proba')}, false AS is_probability FROM pred"),
    "conformal_interval": _with(LABELED, CONFORMAL, "i AS (SELECT sc.symbol, sc.timeframe, ts, proba, greatest(proba - coalesce(q_hat, 0.08), 0) AS lo, least(proba + coalesce(q_hat, 0.08), 1) AS hi FROM sc LEFT JOIN cq USING (symbol, timeframe))", select=f"SELECT {KEYS}, ts, {_r('proba')}, true AS is_probability, {_r('lo', 'hi')}, lo > 1.0 / 3 AS ev_positive FROM i"),
    "tier_b": _with(BARS, *_TIERB, select=f"SELECT {KEYS}, round(price, 6) AS price, zone_kind, zone_price, distance_pct, at_zone, bias FROM tier"),
    "kelly_sizing": _with(LABELED, select=f"SELECT {KEYS}, ts, {_r('proba')}, {_KELLY} FROM sc"),
    "headlines_recent": _with(HEADS, select="SELECT symbol, doc_id, title, published_at, score, n FROM recent"),
    "sentiment_parse": "SELECT doc_id, coalesce(greatest(least(TRY_CAST(regexp_extract(text, '-?[0-9]+(?:[.][0-9]+)?') AS DOUBLE), 1), -1), 0) AS score FROM documents",
    "news_overlay": _with(HEADS, "g AS (SELECT symbol, coalesce(avg(score), 0) AS s, count(*) AS news_count FROM recent GROUP BY symbol)", select="SELECT symbol, round(s, 4) AS news_score, news_count, CASE WHEN s > 0.15 THEN 'bullish' WHEN s < -0.15 THEN 'bearish' ELSE 'neutral' END AS tag FROM g"),
    "market_overview": _with(BARS, _pos(), "w AS (SELECT *, avg(greatest(close - pc, 0)) OVER g AS gain, avg(greatest(pc - close, 0)) OVER g AS loss, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ts DESC) AS rn FROM b WINDOW g AS (PARTITION BY symbol, timeframe ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))", "v AS (SELECT *, CASE WHEN pos < 14 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi FROM w WHERE rn <= 30)", select=f"SELECT {KEYS}, round(arg_max(close, ts), 2) AS price, round((arg_max(close, ts) - arg_min(close, ts)) / arg_min(close, ts) * 100, 2) AS change, CAST(count(*) AS INTEGER) AS n, CAST(arg_max(volume, ts) AS BIGINT) AS volume, CASE WHEN arg_max(rsi, ts) > 55 THEN 'bullish' WHEN arg_max(rsi, ts) < 45 THEN 'bearish' ELSE 'neutral' END AS signal FROM v GROUP BY ALL"),
    "stale_series": _with(TICKS, _ohlc("bars", "15m", "time_bucket(INTERVAL '15 minutes', ts)"), select=f"SELECT {KEYS}, max(ts) AS last_ts, epoch((SELECT max(ts) FROM bars)) - epoch(max(ts)) > 1800 AS stale FROM bars GROUP BY symbol, timeframe"),
}
ORACLES |= {
    "bars_read": ORACLES["bars_load"],
    "matrix_read": ORACLES["feature_matrix"],
    "metrics_log": _with(LABELED, _SKILL, select=f"SELECT {KEYS}, {_r('brier', 'skill')} FROM bs"),
    "trade_log_append": ORACLES["trade_log_valid"],
    "vif_report": ORACLES["vif"],
    "stream_stale": ORACLES["stale_series"],
    "high_corr_pairs_published": ORACLES["high_corr_pairs"].replace("abs(r) > 0.25", "abs(r) > 0.85"),
    "lower_names": "SELECT event_id, event_type, round(value, 6) AS value FROM events",
}
