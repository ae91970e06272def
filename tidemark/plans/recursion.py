"""Registered queries of recursive indicators.

The exponential recursions have oracles by recursive common table expressions; state machines with
feedback (cycles, zigzag) have none and are tested against plain loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import kernels as K
from tidemark.sources import views as V


def indicators(*names: str, digits: int = 6):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = K.per_symbol(V.bars(spark, sf_dir), lambda b: {n: v for n, v in K.indicator_set(b).items() if n in names}, list(names))
        return df.select("symbol", V.epoch(), *(F.round(n, digits).alias(n) for n in names))

    return query


NUMBERED = """b AS (SELECT symbol, ts, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n,
 lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM v_bars)"""
TR = "CASE WHEN n = 1 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END"


def recursive(body: str) -> str:
    """A body that needs recursion, after the views."""
    return V.oracle("WITH " + body, "v_bars").replace("WITH ", "WITH RECURSIVE ", 1)


ATR = recursive(f"""{NUMBERED}, t AS (SELECT symbol, ts, n, {TR} AS tr FROM b),
 e AS (SELECT symbol, ts, n, tr AS y FROM t WHERE n = 1 UNION ALL SELECT t.symbol, t.ts, t.n, e.y + (t.tr - e.y) / 14 FROM e JOIN t ON t.symbol = e.symbol AND t.n = e.n + 1)
 SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(y, 6) AS atr FROM e""")
EMA = recursive(f"""{NUMBERED}, e AS (SELECT symbol, ts, n, close AS a, close AS c2, close AS c3 FROM b WHERE n = 1 UNION ALL
 SELECT b.symbol, b.ts, b.n, e.a + (b.close - e.a) * 2 / 21, e.c2 + ((e.a + (b.close - e.a) * 2 / 21) - e.c2) * 2 / 21,
 e.c3 + ((e.c2 + ((e.a + (b.close - e.a) * 2 / 21) - e.c2) * 2 / 21) - e.c3) * 2 / 21 FROM e JOIN b ON b.symbol = e.symbol AND b.n = e.n + 1)
 SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(a, 6) AS ema, round(3 * (a - c2) + c3, 6) AS tema FROM e""")
KELTNER = recursive(f"""{NUMBERED}, t AS (SELECT symbol, ts, n, close, {TR} AS tr FROM b), e AS (SELECT symbol, ts, n, close AS m, tr AS y FROM t WHERE n = 1 UNION ALL
 SELECT t.symbol, t.ts, t.n, e.m + (t.close - e.m) * 2 / 21, e.y + (t.tr - e.y) / 10 FROM e JOIN t ON t.symbol = e.symbol AND t.n = e.n + 1)
 SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(m, 6) AS kc_mid, round(m + 2 * y, 6) AS kc_up, round(m - 2 * y, 6) AS kc_low FROM e""")
RSI = recursive(f"""{NUMBERED}, e AS (SELECT symbol, ts, n, CAST(NULL AS DOUBLE) AS u, CAST(NULL AS DOUBLE) AS d FROM b WHERE n = 1 UNION ALL
 SELECT b.symbol, b.ts, b.n, CASE WHEN e.u IS NULL THEN greatest(b.close - b.pc, 0) ELSE e.u + (greatest(b.close - b.pc, 0) - e.u) / 14 END,
 CASE WHEN e.d IS NULL THEN greatest(b.pc - b.close, 0) ELSE e.d + (greatest(b.pc - b.close, 0) - e.d) / 14 END FROM e JOIN b ON b.symbol = e.symbol AND b.n = e.n + 1)
 SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(CASE WHEN d = 0 THEN 100.0 ELSE 100 - 100 / (1 + u / d) END, 6) AS rsi FROM e""")

ADX = recursive(f"""{NUMBERED}, h AS (SELECT *, lag(high) OVER (PARTITION BY symbol ORDER BY ts) AS ph, lag(low) OVER (PARTITION BY symbol ORDER BY ts) AS pl FROM b),
 t AS (SELECT symbol, ts, n, {TR} AS tr, CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS u, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS d FROM h),
 e AS (SELECT symbol, ts, n, tr AS w, u::DOUBLE AS p, d::DOUBLE AS m FROM t WHERE n = 1 UNION ALL
  SELECT t.symbol, t.ts, t.n, e.w + (t.tr - e.w) / 14, e.p + (t.u - e.p) / 14, e.m + (t.d - e.m) / 14 FROM e JOIN t ON t.symbol = e.symbol AND t.n = e.n + 1),
 x AS (SELECT symbol, ts, n, 100 * p / nullif(w, 0) AS p, 100 * m / nullif(w, 0) AS m FROM e),
 y AS (SELECT *, abs(p - m) / CASE WHEN p + m = 0 THEN 1 ELSE p + m END AS dx FROM x),
 a AS (SELECT symbol, ts, n, p, m, dx AS a FROM y WHERE n = 1 UNION ALL
  SELECT y.symbol, y.ts, y.n, y.p, y.m, CASE WHEN a.a IS NULL THEN y.dx ELSE a.a + (y.dx - a.a) / 14 END FROM a JOIN y ON y.symbol = a.symbol AND y.n = a.n + 1)
 SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(p, 6) AS di_plus, round(m, 6) AS di_minus, round(100 * a, 6) AS adx FROM a""")
STOCH = RSI[: RSI.rindex("SELECT symbol, CAST")].rstrip() + """, r AS (SELECT symbol, ts, n, CASE WHEN d = 0 THEN 100.0 ELSE 100 - 100 / (1 + u / d) END AS r FROM e),
 x AS (SELECT *, CASE WHEN count(r) OVER w = 14 THEN 100 * (r - min(r) OVER w) / nullif(max(r) OVER w - min(r) OVER w, 0) END AS raw FROM r WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
 k AS (SELECT *, CASE WHEN count(raw) OVER w = 3 THEN avg(raw) OVER w END AS k FROM x WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
 SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, round(k, 4) AS stoch_rsi_k, round(CASE WHEN count(k) OVER w = 3 THEN avg(k) OVER w END, 4) AS stoch_rsi_d FROM k WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""

DEW = recursive(f"""{NUMBERED}, e AS (SELECT symbol, ts, n, close, close::DOUBLE AS m FROM b WHERE n = 1 UNION ALL SELECT b.symbol, b.ts, b.n, b.close, e.m + (b.close - e.m) * 2 / 11 FROM e JOIN b ON b.symbol = e.symbol AND b.n = e.n + 1),
 a AS (SELECT *, coalesce(lag(close, 11) OVER o - CASE WHEN count(*) OVER d >= 10 THEN avg(close) OVER d END > 0, false) AS up, sum(close * n) OVER w AS cn, sum(close) OVER w AS cs, count(*) OVER w AS k FROM e
  WINDOW o AS (PARTITION BY symbol ORDER BY n), d AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
 c AS (SELECT *, coalesce(CASE WHEN k = 30 THEN close > (cn - (n - 30) * cs) / 465 END, false) AS above FROM a),
 x AS (SELECT *, above AND NOT coalesce(lag(above) OVER o, false) AS cu, NOT above AND coalesce(lag(above) OVER o, false) AS cd FROM c WINDOW o AS (PARTITION BY symbol ORDER BY n)),
 s AS (SELECT *, CASE WHEN (cd AND NOT up) OR (close > m * 1.06 AND (cd OR NOT up)) THEN -1.0 WHEN (cu AND up) OR (close < m * 0.94 AND (cu OR up)) THEN 1.0 END AS s FROM x)
 SELECT symbol, CAST(epoch(ts) AS BIGINT) AS ts, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY n ROWS UNBOUNDED PRECEDING), 0.0)::DOUBLE AS envelope_signal FROM s""")

#: The dominant cycle as ``sm`` of each bar ``n``: a recursion that carries the last values of its filters as lists.
TAPS = "(0.0962 * {0} + 0.5769 * {1} - 0.5769 * {2} - 0.0962 * {3})"
CYCLE = f"""{NUMBERED}, tp AS (SELECT *, (high + low + close) / 3 AS x, {TR} AS tr FROM b),
 sx AS (SELECT *, CASE WHEN n <= 7 THEN x ELSE (4 * x + 3 * lag(x, 1) OVER o + 2 * lag(x, 2) OVER o + lag(x, 3) OVER o) / 10 END AS s FROM tp WINDOW o AS (PARTITION BY symbol ORDER BY n)),
 sl AS (SELECT symbol, n, {TAPS.format('s', 'lag(s, 2) OVER o', 'lag(s, 4) OVER o', 'lag(s, 6) OVER o')} AS h FROM sx WINDOW o AS (PARTITION BY symbol ORDER BY n)),
 cy AS (SELECT symbol, n, [0.0, 0, 0, 0, 0, 0]::DOUBLE[] AS d, [0.0, 0, 0, 0, 0, 0]::DOUBLE[] AS q, [0.0, 0, 0, 0, 0, 0]::DOUBLE[] AS p, [0.0, 0]::DOUBLE[] AS i2, [0.0, 0]::DOUBLE[] AS q2,
   0.0::DOUBLE AS re, 0.0::DOUBLE AS im, 0.0::DOUBLE AS pe, 0.0::DOUBLE AS sm FROM sl WHERE n = 1
  UNION ALL SELECT symbol, n, CASE WHEN n <= 7 THEN d ELSE [dn] || d[1:5] END, CASE WHEN n <= 7 THEN q ELSE [qn] || q[1:5] END, CASE WHEN n <= 7 THEN p ELSE [pn] || p[1:5] END,
   CASE WHEN n <= 7 THEN i2 ELSE [i2n, i2[1]] END, CASE WHEN n <= 7 THEN q2 ELSE [q2n, q2[1]] END, CASE WHEN n <= 7 THEN re ELSE ren END, CASE WHEN n <= 7 THEN im ELSE imn END,
   CASE WHEN n <= 7 THEN pe ELSE pen END, CASE WHEN n <= 7 THEN sm ELSE 0.33 * pen + 0.67 * sm END
  FROM (SELECT *, 0.2 * least(greatest(greatest(least(fresh, 1.5 * pe), 0.67 * pe), 6), 50) + 0.8 * pe AS pen
  FROM (SELECT *, CASE WHEN turn <> 0 THEN 2 * pi() / turn ELSE pe END AS fresh FROM (SELECT *, CASE WHEN imn <> 0 AND ren <> 0 THEN atan(imn / ren) ELSE 0 END AS turn
  FROM (SELECT *, 0.2 * (i2n * i2[1] + q2n * q2[1]) + 0.8 * re AS ren, 0.2 * (i2n * q2[1] - q2n * i2[1]) + 0.8 * im AS imn
  FROM (SELECT *, 0.2 * (pn - {TAPS.format('qn', 'q[2]', 'q[4]', 'q[6]')} * g) + 0.8 * i2[2] AS i2n, 0.2 * (qn + {TAPS.format('pn', 'p[2]', 'p[4]', 'p[6]')} * g) + 0.8 * q2[2] AS q2n
  FROM (SELECT *, {TAPS.format('dn', 'd[2]', 'd[4]', 'd[6]')} * g AS qn, d[3] AS pn FROM (SELECT *, h * g AS dn
  FROM (SELECT sl.symbol, sl.n, h, d, q, p, i2, q2, re, im, pe, sm, 0.075 * pe + 0.54 AS g FROM cy JOIN sl ON sl.symbol = cy.symbol AND sl.n = cy.n + 1)))))))))"""
#: Bars with the cycle's half and whole length, and the windows that follow them.
CYCLED = f"""{CYCLE}, cb AS (SELECT tp.*, sm * 0.5 AS half, sm AS whole FROM tp JOIN cy ON cy.symbol = tp.symbol AND cy.n = tp.n),
 sp AS (SELECT *, CASE WHEN half >= 1 THEN CAST(floor(greatest(half, 1)) AS INT) ELSE 20 END AS k, CASE WHEN half >= 1 THEN CAST(floor(greatest(half, 2)) AS INT) ELSE 20 END AS k2,
  CASE WHEN whole >= 1 THEN CAST(floor(greatest(whole, 1)) AS INT) ELSE 20 END AS kw FROM cb)"""
AT = "symbol, CAST(epoch(ts) AS BIGINT) AS ts"


def follows(name: str, period: str) -> str:
    """The adaptive range by a period, as ``atr`` of the table ``name``."""
    return f"""{name} AS (SELECT symbol, n, CAST(NULL AS DOUBLE) AS seed, tr AS s0, tr AS atr FROM cb WHERE n = 1 UNION ALL
 SELECT cb.symbol, cb.n, NULL, e.s0 + cb.tr, CASE WHEN cb.n <= 3 THEN (e.s0 + cb.tr) / cb.n ELSE e.atr + (1.0 / least(greatest({period}, 3), 50)) * (cb.tr - e.atr) END FROM {name} e JOIN cb ON cb.symbol = e.symbol AND cb.n = e.n + 1)"""


DOMINANT = recursive(f"{CYCLED} SELECT {AT}, round(half, 6) AS period FROM cb")
OSCILLATORS = recursive(f"""{CYCLED}, st AS (SELECT *, coalesce(close - pc, 0) AS step, avg(x) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS wide FROM sp),
 wi AS (SELECT a.symbol, a.n, any_value(a.ts) AS ts, any_value(a.close) AS close, any_value(a.x) AS x, any_value(a.wide) AS wide, avg(greatest(w.step, 0)) AS up, avg(greatest(-w.step, 0)) AS dn,
  max(w.high) AS hi, min(w.low) AS lo, avg(abs(w.x - w.wide)) AS spread FROM st a JOIN st w ON w.symbol = a.symbol AND w.n BETWEEN a.n - a.k + 1 AND a.n GROUP BY a.symbol, a.n)
 SELECT {AT}, round(CASE WHEN up + dn = 0 THEN 50 ELSE 100 * up / (up + dn) END, 6) AS adaptive_rsi, round(CASE WHEN hi = lo THEN 50 ELSE 100 * (close - lo) / (hi - lo) END, 6) AS adaptive_stoch,
 round(CASE WHEN hi = lo THEN 0 ELSE 200 * (close - (hi + lo) / 2) / (hi - lo) END, 6) AS adaptive_smi, round(CASE WHEN spread > 1e-10 THEN (x - wide) / (0.015 * spread) END, 6) AS adaptive_cci FROM wi""")
LAGUERRE = recursive(f"""{CYCLED}, gm AS (SELECT symbol, ts, n, close, 0.5::DOUBLE AS g0, least(greatest(4 / greatest(half, 4), 0.1), 0.9)::DOUBLE AS g1 FROM cb),
 la AS (SELECT symbol, ts, n, [close, close, close, close]::DOUBLE[] AS a, [close, close, close, close]::DOUBLE[] AS b FROM gm WHERE n = 1 UNION ALL SELECT symbol, ts, n, [a1, a2, a3, -g0 * a3 + a[3] + g0 * a[4]], [b1, b2, b3, -g1 * b3 + b[3] + g1 * b[4]]
  FROM (SELECT *, -g0 * a2 + a[2] + g0 * a[3] AS a3, -g1 * b2 + b[2] + g1 * b[3] AS b3 FROM (SELECT *, -g0 * a1 + a[1] + g0 * a[2] AS a2, -g1 * b1 + b[1] + g1 * b[2] AS b2
  FROM (SELECT gm.symbol, gm.ts, gm.n, a, b, g0, g1, (1 - g0) * close + g0 * a[1] AS a1, (1 - g1) * close + g1 * b[1] AS b1 FROM la JOIN gm ON gm.symbol = la.symbol AND gm.n = la.n + 1)))),
 ud AS (SELECT symbol, ts, greatest(a[1] - a[2], 0) + greatest(a[2] - a[3], 0) + greatest(a[3] - a[4], 0) AS au, greatest(a[2] - a[1], 0) + greatest(a[3] - a[2], 0) + greatest(a[4] - a[3], 0) AS ad,
  greatest(b[1] - b[2], 0) + greatest(b[2] - b[3], 0) + greatest(b[3] - b[4], 0) AS bu, greatest(b[2] - b[1], 0) + greatest(b[3] - b[2], 0) + greatest(b[4] - b[3], 0) AS bd FROM la)
 SELECT {AT}, round(CASE WHEN au + ad <> 0 THEN 100 * au / (au + ad) ELSE 0 END, 6) AS laguerre_rsi, round(CASE WHEN bu + bd <> 0 THEN 100 * bu / (bu + bd) ELSE 0 END, 6) AS adaptive_laguerre_rsi FROM ud""")
MIDDLE = """{name} AS (SELECT a.symbol, a.n, CASE WHEN any_value(a.n) - 1 < any_value(a.k2) + greatest(1, any_value(a.k2) // 4) THEN any_value(a.{x}) WHEN sum(abs(w.{x} - t.{x})) > 0
  THEN sum(abs(w.{x} - t.{x}) * w.{x}) / sum(abs(w.{x} - t.{x})) ELSE avg(w.{x}) END AS mid FROM sp a JOIN sp w ON w.symbol = a.symbol AND w.n BETWEEN a.n - a.k2 + 1 AND a.n
  LEFT JOIN sp t ON t.symbol = w.symbol AND t.n = w.n - greatest(1, a.k2 // 4) GROUP BY a.symbol, a.n)"""
FILTERED = recursive(f"""{CYCLED}, {MIDDLE.format(name='mi', x='x')}, {follows('ra', '2 * cb.half')}
 SELECT cb.symbol, CAST(epoch(cb.ts) AS BIGINT) AS ts, round(mid, 6) AS adaptive_ma, CASE WHEN cb.n >= 3 THEN round(atr, 6) END AS adaptive_atr FROM cb JOIN mi ON mi.symbol = cb.symbol AND mi.n = cb.n JOIN ra ON ra.symbol = cb.symbol AND ra.n = cb.n""")
CHANDELIER = recursive(f"""{CYCLED}, {follows('ra', 'cb.whole / 2')}, wi AS (SELECT a.symbol, a.n, any_value(a.ts) AS ts, max(w.high) AS hi, min(w.low) AS lo FROM sp a JOIN sp w ON w.symbol = a.symbol AND w.n BETWEEN a.n - a.kw + 1 AND a.n GROUP BY a.symbol, a.n)
 SELECT wi.symbol, CAST(epoch(ts) AS BIGINT) AS ts, CASE WHEN wi.n >= 3 THEN round(hi - 3 * atr, 6) END AS chandelier_long, CASE WHEN wi.n >= 3 THEN round(lo + 3 * atr, 6) END AS chandelier_short FROM wi JOIN ra ON ra.symbol = wi.symbol AND ra.n = wi.n""")
SQUEEZE = recursive(f"""{CYCLED}, {follows('ra', 'cb.whole')},
 pw AS (SELECT *, CAST(floor(least(greatest(whole, 6), 50) * 0.5::DOUBLE) AS INT) AS ks, CAST(floor(least(greatest(whole, 6), 50) * 0.7::DOUBLE) AS INT) AS kb, x / lag(x) OVER (PARTITION BY symbol ORDER BY n) - 1 AS r FROM sp),
 mi AS (SELECT a.symbol, a.n, CASE WHEN any_value(a.n) - 1 >= any_value(a.ks + a.kb) AND sum(abs(w.x - t.x)) > 0 THEN sum(abs(w.x - t.x) * w.x) / sum(abs(w.x - t.x)) ELSE any_value(a.x) END AS mid
  FROM pw a JOIN pw w ON w.symbol = a.symbol AND w.n BETWEEN a.n - a.ks + 1 AND a.n LEFT JOIN pw t ON t.symbol = w.symbol AND t.n = w.n - a.kb GROUP BY a.symbol, a.n),
 gv AS (SELECT symbol, n, CASE WHEN count(r) OVER w = 20 THEN exp(avg(ln(1 + r)) OVER w) END AS g, var_samp(r) OVER w AS v FROM pw WINDOW w AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 dv AS (SELECT symbol, n, sqrt(greatest(pow(greatest(v + g * g, 1e-12), 20) - pow(greatest(g, 1e-12), 40), 0)) AS d FROM gv WHERE g IS NOT NULL),
 hl AS (SELECT a.symbol, a.n, ((max(w.high) + min(w.low)) / 2 + avg(w.close)) / 2 AS base FROM sp a JOIN sp w ON w.symbol = a.symbol AND w.n BETWEEN a.n - a.kw + 1 AND a.n GROUP BY a.symbol, a.n),
 yy AS (SELECT sp.symbol, sp.n, sp.ts, kw, whole, x - base AS y, mid, 0.7 * mid * d AS band, 1.5 * CASE WHEN sp.n >= 3 THEN atr END AS width FROM sp JOIN mi ON mi.symbol = sp.symbol AND mi.n = sp.n JOIN hl ON hl.symbol = sp.symbol AND hl.n = sp.n
  JOIN ra ON ra.symbol = sp.symbol AND ra.n = sp.n LEFT JOIN dv ON dv.symbol = sp.symbol AND dv.n = sp.n),
 lr AS (SELECT a.symbol, a.n, CASE WHEN count(*) = 1 OR any_value(a.whole) < 2 THEN 0 ELSE regr_intercept(w.y, w.n - a.n) END AS m FROM yy a JOIN yy w ON w.symbol = a.symbol AND w.n BETWEEN a.n - a.kw + 1 AND a.n GROUP BY a.symbol, a.n)
 SELECT yy.symbol, CAST(epoch(ts) AS BIGINT) AS ts, CASE WHEN mid - band > mid - width AND mid + band < mid + width THEN 1.0 ELSE 0.0 END::DOUBLE AS squeeze_on,
  CASE WHEN mid - band < mid - width AND mid + band > mid + width THEN 1.0 ELSE 0.0 END::DOUBLE AS squeeze_off, round(m, 8) AS squeeze_momentum FROM yy JOIN lr ON lr.symbol = yy.symbol AND lr.n = yy.n""")


def turns(divisor: float, top: str, bottom: str) -> str:
    """Alternating pivots as ``tu`` (symbol, hit, dir, known), from adaptive ranges over ``divisor``."""
    return f"""{CYCLED}, {follows('ra', '2 * cb.half')}, th AS (SELECT cb.symbol, cb.n, cb.ts, {top} AS tp, {bottom} AS bt, CASE WHEN cb.n >= 3 THEN atr / {divisor} END AS t FROM cb JOIN ra ON ra.symbol = cb.symbol AND ra.n = cb.n),
 z0 AS (SELECT symbol, arg_max(n, (tp, -n)) AS hi, arg_min(n, (bt, n)) AS lo FROM th WHERE n <= 20 GROUP BY symbol HAVING count(*) > 1),
 zz AS (SELECT th.symbol, th.n, lo < hi AS up, th.n AS pos, CASE WHEN lo < hi THEN tp ELSE -bt END AS best, CAST(NULL AS BIGINT) AS hit, CAST(NULL AS INT) AS dir FROM th JOIN z0 ON z0.symbol = th.symbol AND th.n = CASE WHEN lo < hi THEN hi ELSE lo END
  UNION ALL SELECT symbol, n, up <> turn, CASE WHEN further OR turn THEN n ELSE pos END, CASE WHEN further THEN edge WHEN turn THEN CASE WHEN up THEN -bt ELSE tp END ELSE best END, CASE WHEN turn THEN pos END, CASE WHEN turn THEN CASE WHEN up THEN 1 ELSE -1 END END
  FROM (SELECT *, NOT further AND coalesce(best - CASE WHEN up THEN bt ELSE -tp END >= t, false) AS turn FROM (SELECT *, edge > best AS further
  FROM (SELECT th.symbol, th.n, up, pos, best, tp, bt, t, CASE WHEN up THEN tp ELSE -bt END AS edge FROM zz JOIN th ON th.symbol = zz.symbol AND th.n = zz.n + 1)))),
 tu AS (SELECT symbol, hit, dir, n AS known FROM zz WHERE hit IS NOT NULL)"""


ZIGZAG = recursive(f"""{turns(5.0, 'close', 'close')} SELECT th.symbol, CAST(epoch(ts) AS BIGINT) AS ts, coalesce(dir, 0)::DOUBLE AS pivot, (known - 1)::DOUBLE AS pivot_known FROM th LEFT JOIN tu ON tu.symbol = th.symbol AND tu.hit = th.n""")
CONFIRMED = recursive(f"""{turns(2.0, 'high', 'low')}, fr AS (SELECT symbol, n, ts, high, low, count(*) OVER l = 3 AND count(*) OVER r = 3 AND high > max(high) OVER l AND high > max(high) OVER r AS fu,
  count(*) OVER l = 3 AND count(*) OVER r = 3 AND low < min(low) OVER l AND low < min(low) OVER r AS fd FROM b
  WINDOW l AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
 SELECT fr.symbol, CAST(epoch(ts) AS BIGINT) AS ts, CAST(n - 1 AS INT) AS idx, dir AS side, CAST(greatest(n - 1 + 3, known - 1) AS BIGINT) AS known, CASE WHEN dir = 1 THEN high ELSE low END AS price
 FROM fr JOIN tu ON tu.symbol = fr.symbol AND tu.hit = fr.n WHERE (dir = 1 AND fu) OR (dir = -1 AND fd)""")

QUERIES = {
    "atr_rma": (indicators("atr"), ATR),
    "ema_tema": (indicators("ema", "tema"), EMA),
    "keltner": (indicators("kc_mid", "kc_up", "kc_low"), KELTNER),
    "rsi": (indicators("rsi"), RSI),
    "adx": (indicators("di_plus", "di_minus", "adx"), ADX),
    "stoch_rsi": (indicators("stoch_rsi_k", "stoch_rsi_d", digits=4), STOCH),
    "dominant_cycle": (indicators("period"), DOMINANT),
    "adaptive_oscillators": (indicators("adaptive_rsi", "adaptive_stoch", "adaptive_smi", "adaptive_cci"), OSCILLATORS),
    "laguerre_rsi": (indicators("laguerre_rsi", "adaptive_laguerre_rsi"), LAGUERRE),
    "adaptive_ma_atr": (indicators("adaptive_ma", "adaptive_atr"), FILTERED),
    "adaptive_chandelier": (indicators("chandelier_long", "chandelier_short"), CHANDELIER),
    "envelope_signal": (indicators("envelope_signal"), DEW),
    "squeeze": (indicators("squeeze_on", "squeeze_off", "squeeze_momentum", digits=8), SQUEEZE),
    "zigzag": (indicators("pivot", "pivot_known"), ZIGZAG),
}
