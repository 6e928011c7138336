"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

import math

from tapeworks.operators import analyser
from tapeworks.operators.recurrence import Average
from tapeworks.plans import settings as S

#: The normal quantile of 0.9.
Z90 = 1.2815515655446004


def decay(halflife: float) -> float:
    """What remains of an average after one bar."""
    return math.exp(-math.log(2.0) / halflife)

BLOCK = 600


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def ticks(panel: bool = False, bar: int = 60) -> str:
    return f"""ticks AS (
        SELECT {"event_type" if panel else "'ALL'"} AS symbol, epoch_us(ts) // {bar}000000 AS t, ts, event_id, value + 1000.0 AS price, value AS size,
               CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS taker
        FROM events WHERE ts IS NOT NULL AND value IS NOT NULL
    )"""


def bars(panel: bool = False, bar: int = 60) -> str:
    return ticks(panel, bar) + """, sums AS (
        SELECT symbol, t, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close,
               sum(size) AS vol, sum(size * price) AS qvol, count(*) AS ntrades, sum(taker) AS tb
        FROM ticks GROUP BY symbol, t
    ), bars AS (
        SELECT symbol, t, round_even(open * 100, 0) / 100 AS open, round_even(high * 100, 0) / 100 AS high, round_even(low * 100, 0) / 100 AS low,
               round_even(close * 100, 0) / 100 AS close, round_even(vol * 1e5, 0) / 1e5 AS vol, round_even(qvol, 0) AS qvol, ntrades,
               round_even(CASE WHEN vol > 0 THEN least(greatest(tb / greatest(vol, 1e-12), 0.0), 1.0) ELSE 0.0 END * 65535.0, 0) / 65535.0 AS takerfrac
        FROM sums
    )"""


def grid(panel: bool = False, bar: int = 60, upto: str = "") -> str:
    """upto: the last bar of every symbol, which then begins with its own first."""
    ends = "SELECT symbol, (SELECT min(t) FROM bars) AS a, (SELECT max(t) FROM bars) AS b FROM (SELECT DISTINCT symbol FROM bars)" if panel else "SELECT symbol, min(t) AS a, max(t) AS b FROM bars GROUP BY symbol"
    ends = f"SELECT symbol, min(t) AS a, {upto} AS b FROM bars GROUP BY symbol HAVING min(t) <= {upto}" if upto else ends
    return bars(panel, bar) + f""", ends AS ({ends}), skeleton AS (
        SELECT symbol, unnest(generate_series(a, b)) AS t FROM ends
    ), met AS (
        SELECT s.symbol, s.t, b.* EXCLUDE (symbol, t), b.close IS NOT NULL AS valid
        FROM skeleton s LEFT JOIN bars b ON s.symbol = b.symbol AND s.t = b.t
    ), known AS (
        SELECT *, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING),
                           first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS c
        FROM met
    ), tape AS (
        SELECT symbol, t, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close, coalesce(vol, 0.0) AS vol,
               coalesce(qvol, 0.0) AS qvol, coalesce(takerfrac, 0.0) AS takerfrac, coalesce(ntrades, 0) AS ntrades, valid
        FROM known
    )"""


def logs(panel: bool = False, bar: int = 60) -> str:
    return grid(panel, bar) + """, logs AS (
        SELECT symbol, t, ln(greatest(close, 1e-9)) AS logp, close, ln(greatest(high, 1e-9)) - ln(greatest(close, 1e-9)) AS hi_off,
               ln(greatest(low, 1e-9)) - ln(greatest(close, 1e-9)) AS lo_off, ln(1 + greatest(vol, 0.0)) AS lv, ln(1 + greatest(ntrades::DOUBLE, 0.0)) AS lntr,
               CASE WHEN vol > 0 THEN (takerfrac - 0.5) * 2 ELSE 0.0 END AS imb, valid
        FROM tape
    )"""


def averages(source: str, specs, tag: str, block: int = BLOCK) -> str:
    """Closed form within short blocks, and a recursion over blocks; gives the table of that tag."""
    local = ", ".join(f"{1 - decay(s.halflife)!r} * power({decay(s.halflife)!r}, j) * sum({s.of} * power({decay(s.halflife)!r}, -j)) OVER w AS l_{s.name}" for s in specs)
    ends = ", ".join(f"arg_max(l_{s.name}, j) AS l_{s.name}" for s in specs)
    first = ", ".join(f"CAST({f'arg_min({s.of}, t)' if s.first is None else s.first} AS DOUBLE) AS c_{s.name}" for s in specs)
    fold = ", ".join(f"e.l_{s.name} + power({decay(s.halflife)!r}, e.n) * c.c_{s.name}" for s in specs)
    done = ", ".join(f"l_{s.name} + c_{s.name} * power({decay(s.halflife)!r}, j + 1) AS {s.name}" for s in specs)
    return f""", {tag}_at AS (
        SELECT *, (t - min(t) OVER (PARTITION BY symbol)) // {block} AS blk, (t - min(t) OVER (PARTITION BY symbol)) % {block} AS j FROM {source}
    ), {tag}_local AS (
        SELECT *, {local} FROM {tag}_at WINDOW w AS (PARTITION BY symbol, blk ORDER BY j ROWS UNBOUNDED PRECEDING)
    ), {tag}_ends AS (SELECT symbol, blk, count(*) AS n, {ends} FROM {tag}_local GROUP BY symbol, blk), {tag}_carry AS (
        SELECT symbol, CAST(0 AS BIGINT) AS blk, {first} FROM {source} GROUP BY symbol
        UNION ALL
        SELECT c.symbol, c.blk + 1, {fold} FROM {tag}_carry c JOIN {tag}_ends e ON e.blk = c.blk AND e.symbol = c.symbol
    ), {tag} AS (SELECT l.* EXCLUDE (blk, j), {done} FROM {tag}_local l JOIN {tag}_carry c ON c.blk = l.blk AND c.symbol = l.symbol)"""


def lagged(k: int) -> str:
    return f"coalesce(lag(logp, {k}) OVER o, first_value(logp) OVER o) AS lag_{k}"


def analysed(panel: bool = False, upto: str = "") -> str:
    ks = sorted({*analyser.RETURNS, 120})
    text = grid(panel, upto=upto) + f""", prices AS (SELECT *, ln(greatest(close, 1e-12)) AS logp FROM tape), back AS (
        SELECT *, {", ".join(map(lagged, ks))} FROM prices WINDOW o AS (PARTITION BY symbol ORDER BY t)
    ), flows AS (
        SELECT *, logp - lag_1 AS r1, ln(1 + greatest(vol, 0.0)) AS lv, ln(1 + greatest(ntrades::DOUBLE, 0.0)) AS ln,
               CASE WHEN vol > 0 THEN (takerfrac - 0.5) * 2 ELSE 0.0 END AS imb, greatest(qvol, 0.0) AS qv, greatest(vol, 0.0) AS bv,
               ln(greatest(high, 1e-12) / greatest(low, 1e-12)) AS hl, CAST(valid AS INT)::DOUBLE AS ok
        FROM back
    ), inputs AS (
        SELECT *, r1 * r1 AS r2, imb * lv AS sv, (imb * lv) * (imb * lv) AS sv2, abs(r1) / greatest(qv, 1.0) AS ami, greatest(r1, 0.0) AS up, greatest(-r1, 0.0) AS down FROM flows
    )"""
    text += averages("inputs", analyser.FIRST, "one")
    text += ", squared AS (SELECT *, power(lv - lv_3600, 2) AS lv_dev2, power(ln - ln_3600, 2) AS ln_dev2 FROM one)"
    return text + averages("squared", [Average("lv_dev", "lv_dev2", 3600), Average("ln_dev", "ln_dev2", 3600)], "two")


def feature_sql() -> dict[str, str]:
    A = analyser
    sig = {h: f"sqrt(greatest(var_{h}, 0.0))" for h in A.VOLATILITY}
    over = lambda h: f"(greatest({sig[300]}, 1e-7) * {math.sqrt(h)!r})"
    ret = lambda k: f"(logp - lag_{k})"
    out = {f"ret_{k}s_z": f"{ret(k)} / {over(k)}" for k in A.RETURNS}
    out |= {f"ret_{k}s_tanh": f"tanh({ret(k)} * 200.0)" for k in A.RETURNS}
    out |= {f"logvol_{h}s": f"ln(greatest({sig[h]}, 1e-9)) + 9.0" for h in A.VOLATILITY}
    out |= {f"volratio_{a}_{b}": f"ln(greatest({sig[a]}, 1e-9) / greatest({sig[b]}, 1e-9))" for a, b in zip(A.VOLATILITY, A.VOLATILITY[1:])}
    out |= {f"trend_z_{h}s": f"(logp - trend_{h}) / {over(h)}" for h in A.TREND}
    out |= {f"range_{h}s": f"ln(greatest(range_{h}, 1e-9)) + 9.0" for h in A.RANGE}
    out["vol_z"] = "(lv - lv_3600) / sqrt(greatest(lv_dev, 1e-9))"
    out["logvol_ratio_60_3600"], out["logvol_ratio_300_43200"] = "lv_60 - lv_3600", "lv_300 - lv_43200"
    out["ntrades_z"], out["ntrades_ratio_60_3600"] = "(ln - ln_3600) / sqrt(greatest(ln_dev, 1e-9))", "ln_60 - ln_3600"
    out |= {f"flow_imb_{h}s": f"imb_{h}" for h in A.FLOW}
    out |= {f"signed_vol_{h}s": f"sv_{h} / sqrt(greatest(sv2_{h}, 1e-9))" for h in A.FLOW}
    out |= {f"vwap_dev_{h}s": f"ln(greatest(close, 1e-12) / greatest(CASE WHEN bv_{h} > 1e-12 THEN qv_{h} / greatest(bv_{h}, 1e-12) ELSE close END, 1e-12)) / {over(h)}" for h in A.RANGE}
    out |= {f"amihud_{h}s": f"ln(greatest(ami_{h}, 1e-15)) + 18.0" for h in A.ILLIQUIDITY}
    for name, x in (("tod", "((t * 60) % 86400) / 86400.0"), ("dow", "(((t * 60) // 86400) % 7) / 7.0")):
        out |= {f"{name}_{f}": f"{f}({2 * math.pi!r} * {x})" for f in ("sin", "cos")}
    out["valid_frac_300s"], out["gap_flag"] = "ok_300", "1.0 - ok"
    out["accel_60s"] = f"(2 * {ret(60)} - {ret(120)}) / {over(60)}"
    out["rsi_900s"] = "(up_900 - down_900) / greatest(up_900 + down_900, 1e-12)"
    return {k: f"greatest(least(coalesce({v}, 0.0), 8.0), -8.0)" for k, v in out.items()}


def features(*names: str) -> str:
    made = feature_sql()
    return f"WITH RECURSIVE {analysed()} SELECT symbol, t, {', '.join(r6(made[n], n) for n in names)} FROM two"


def streamed_features() -> str:
    """Features up to the last bar that closed ten minutes before the last event."""
    made = feature_sql()
    last = "(SELECT max(t) FROM bars WHERE (t + 1) * 60 <= (SELECT epoch_us(max(ts)) / 1e6 - 600 FROM events))"
    return f"WITH RECURSIVE {analysed()} SELECT symbol, t, valid, {', '.join(r6(x, n) for n, x in made.items())} FROM two WHERE t <= {last}"


def panel_features() -> str:
    """Features of every symbol up to the last bar that ended ten minutes before the last event."""
    made = feature_sql()
    last = "(SELECT (epoch_us(max(ts)) // 1000000 - 600) // 60 - 1 FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL)"
    return f"WITH RECURSIVE {analysed(True, last)} SELECT symbol, t, valid, {', '.join(r6(x, n) for n, x in made.items())} FROM two"


def volatility(panel: bool = False, bar: int = 60) -> str:
    """The tape with sig and signal at every t: the volatility at hand over 300 bars, and the last 60 bars' move in units of it."""
    text = grid(panel, bar) + """, back AS (
        SELECT *, logp - coalesce(lag(logp) OVER o, logp) AS r1, logp - coalesce(lag(logp, 60) OVER o, first_value(logp) OVER o) AS move
        FROM (SELECT *, ln(greatest(close, 1e-12)) AS logp FROM tape) WINDOW o AS (PARTITION BY symbol ORDER BY t)
    ), squares AS (SELECT *, r1 * r1 AS r2 FROM back)"""
    text += averages("squares", [Average("var_300", "r2", 300)], "varied", BLOCK if bar > 1 else 30_000)
    held = lambda x: f"greatest(least({x}, 8.0), -8.0)"
    dev = "sqrt(greatest(var_300, 0.0))"
    return text + f", vol AS (SELECT symbol, t, logp, close, exp({held(f'ln(greatest({dev}, 1e-9)) + 9.0')} - 9.0) AS sig, {held(f'move / (greatest({dev}, 1e-7) * {math.sqrt(60)!r})')} AS signal FROM varied)"


def session_cursors(z) -> str:
    """Cursors of a day drawn by seed, which begins no sooner than full context and ends no later than full futures allow."""
    return f""", room AS (SELECT symbol, a, b, greatest(a, b - {z.DAY}) AS l FROM (SELECT symbol, min(t) + {z.CONTEXT} + 1 AS a, max(t) - {z.HORIZON} + 1 AS b FROM tape GROUP BY symbol) WHERE a < b),
    picked AS (SELECT symbol, a, b, l, arg_min(day, md5('{z.SEED}-' || day::VARCHAR)) AS day FROM (SELECT *, unnest(generate_series(a // {z.DAY}, l // {z.DAY})) AS day FROM room) GROUP BY ALL),
    replayed AS (SELECT symbol, b, least(greatest(a, day * {z.DAY}), l) AS a FROM picked),
    cursors AS (SELECT symbol, t, t AS id FROM (SELECT symbol, unnest(generate_series(a, least(b, a + {z.DAY}) - 1, {z.STRIDE})) AS t FROM replayed))"""


def cursors(z=S) -> str:
    if hasattr(z, "SEED"):
        return session_cursors(z)
    return f", cursors AS (SELECT symbol, t, t AS id FROM (SELECT symbol, t, min(t) OVER w AS a, max(t) OVER w AS b FROM tape WINDOW w AS (PARTITION BY symbol)) WHERE t >= a + {z.CONTEXT} + 1 AND t < b - {z.HORIZON} + 1 AND (t - a - {z.CONTEXT} - 1) % {z.STRIDE} = 0)"


def truth(z=S) -> str:
    return f", truth AS (SELECT c.id, c.symbol, c.t, c.h, ln(greatest(x.close, 1e-9)) - ln(greatest(c.close, 1e-9)) AS truth FROM (SELECT c.*, y.close, unnest(generate_series(1, {z.HORIZON})) AS h FROM cursors c JOIN tape y ON y.t = c.t AND y.symbol = c.symbol) c JOIN tape x ON x.symbol = c.symbol AND x.t = c.t + c.h)"


def window(panel: bool = False) -> str:
    return logs(panel) + cursors() + f", wide AS (SELECT c.id, c.symbol, c.t, c.pos, x.logp - c.logp AS rel, x.hi_off, x.lo_off, x.lv, x.lntr, x.imb, x.valid FROM (SELECT c.*, y.logp, unnest(generate_series(1, {S.CONTEXT})) AS pos FROM cursors c JOIN logs y ON y.t = c.t AND y.symbol = c.symbol) c JOIN logs x ON x.symbol = c.symbol AND x.t = c.t + c.pos - {S.CONTEXT})"


def basis_sql(z=S) -> str:
    return f"basis AS (SELECT h, k, {math.sqrt(2.0)!r} * sin(h / {z.HORIZON}.0 * ((k - 0.5) * pi())) / ((k - 0.5) * pi()) AS phi FROM generate_series(1, {z.HORIZON}) a(h), generate_series(1, {z.MODES}) b(k))"


def softplus(x: str) -> str:
    return f"(greatest({x}, 0.0) + ln(1 + exp(-abs({x}))))"


def offset(z=S) -> float:
    """What each mode is moved by so that at the horizon a path lies Z90 deviations of a walk from the median."""
    return Z90 / sum(math.sqrt(2.0) * math.sin((k - 0.5) * math.pi) / ((k - 0.5) * math.pi) for k in range(1, z.MODES + 1))


def forecasts(panel: bool = False, z=S) -> str:
    """Forecasts of all models: model, symbol, id, t, sig, q, h, path."""
    models = ", ".join(f"('{m}', {d!r})" for m, d in z.MODELS)
    return volatility(panel, z.BAR) + cursors(z) + ", " + basis_sql(z) + f""", models AS (SELECT * FROM (VALUES {models}) m(model, drift)), lead AS (
        SELECT model, c.symbol, id, c.t, sig, q, list_transform(generate_series(1, {z.MODES}), lambda k: CASE WHEN k = 1 THEN drift * signal ELSE 0.0 END + (q - 1) * {offset(z)!r}) AS coef
        FROM cursors c JOIN vol v ON v.t = c.t AND v.symbol = c.symbol, models, generate_series(0, 2) a(q)
    ), modes AS (SELECT h, list(phi ORDER BY k) AS phi FROM basis GROUP BY h), forecasts AS (
        SELECT model, symbol, id, t, sig, q, h, list_inner_product(coef, phi) * greatest(sig, 1e-8) * {math.sqrt(z.HORIZON)!r} AS path FROM lead, modes
    )"""


def scored(panel: bool = False, z=S) -> str:
    by = f"greatest(sig, 1e-9) * {math.sqrt(z.HORIZON)!r}"
    return forecasts(panel, z) + truth(z) + f""", each AS (
        SELECT model, f.symbol, f.t, sqrt(avg(power((path - truth) / ({by}), 2))) AS nrmse, sqrt(avg(power(truth / ({by}), 2))) AS flat_nrmse,
               arg_max(path, h) AS e, arg_max(truth, h) AS te, any_value({by}) AS sc
        FROM forecasts f JOIN truth USING (symbol, id, h) WHERE q = 1 GROUP BY model, f.symbol, f.t
    ), found AS (
        SELECT model, symbol, t, nrmse, flat_nrmse, (sign(e) = sign(te))::INT::DOUBLE AS dir_hit, abs(e - te) / sc AS endpoint,
               coalesce(abs(e - lag(e) OVER o) / sc, 0.0) AS jump
        FROM each WINDOW o AS (PARTITION BY model, symbol ORDER BY t)
    ), scores AS (
        SELECT *, avg(dir_hit) OVER o AS roll_hit, avg(nrmse) OVER o AS roll_nrmse FROM found
        WINDOW o AS (PARTITION BY model, symbol ORDER BY t ROWS BETWEEN {z.ROLL - 1} PRECEDING AND CURRENT ROW)
    )"""
