"""The engine's queries as SQL, built from shared common table expressions.

Each function below returns CTEs or expressions; nothing is read from the DataFrame code, so that
the SQL is a second derivation of every result.
"""

from __future__ import annotations

VALUE = "s AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value AS y FROM events)"
DIFF = VALUE.replace("s AS", "s_all AS") + ", s AS (SELECT t - 1 AS t, step AS y FROM (SELECT t, y - lag(y) OVER (ORDER BY t) AS step FROM s_all) WHERE t > 0)"
GAPS = "s AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS t, CASE WHEN event_id % 97 = 13 THEN NULL ELSE value END AS y FROM events)"


def control_points(src: str = "s", y: str = "y") -> str:
    pick = lambda d: f"(0.5 * (max(CASE WHEN rn = floor({d}) THEN {y} END) + max(CASE WHEN rn = ceil({d}) THEN {y} END)))"
    return f"""ordered AS (SELECT {y}, row_number() OVER (ORDER BY {y}) AS rn, count(*) OVER () AS n FROM {src} WHERE {y} IS NOT NULL),
depth AS (SELECT max(n) AS n, floor((max(n) + 3) / 2) / 2 AS d1, (max(n) + 1) / 2 AS d2, max(n) + 1 - floor((max(n) + 3) / 2) / 2 AS d3 FROM ordered),
hinge AS (SELECT {pick('d1')} AS q1, {pick('d2')} AS med, {pick('d3')} AS q3 FROM ordered, depth),
extreme AS (SELECT min({y}) AS a, max({y}) AS b, min(CASE WHEN {y} >= q1 - 1.5 * (q3 - q1) THEN {y} END) AS lw, max(CASE WHEN {y} <= q3 + 1.5 * (q3 - q1) THEN {y} END) AS uw, max(med) AS med FROM {src}, hinge),
cp AS (SELECT CASE WHEN a < lw THEN lw ELSE a END AS x_lo, CASE WHEN a < lw THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_lo, med, CASE WHEN b > uw THEN uw ELSE b END AS x_hi, CASE WHEN b > uw THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_hi FROM extreme)"""


def phi(y: str = "y") -> str:
    step = lambda x0, p0, x1, p1: f"(({p0}) + (({p1}) - ({p0})) * (3.0 * (({y} - {x0}) / ({x1} - {x0})) * (({y} - {x0}) / ({x1} - {x0})) - 2.0 * (({y} - {x0}) / ({x1} - {x0})) * (({y} - {x0}) / ({x1} - {x0})) * (({y} - {x0}) / ({x1} - {x0}))))"
    low, high = step("x_lo", "p_lo", "med", "0.0"), step("med", "0.0", "x_hi", "p_hi")
    plain = f"CASE WHEN {y} <= x_lo THEN p_lo WHEN {y} >= x_hi THEN p_hi WHEN {y} < med THEN {low} ELSE {high} END"
    tied = f"CASE WHEN {y} >= x_hi THEN p_hi WHEN {y} >= med THEN {high} WHEN {y} >= x_lo THEN {low} ELSE p_lo END"
    return f"(CASE WHEN x_lo < med AND med < x_hi THEN {plain} ELSE {tied} END)"


def embedded(k: int = 3, horizon: int = 1) -> str:
    lags = ", ".join(f"lag(y, {j}) OVER (ORDER BY t) AS x{j}" for j in range(1, k + 1))
    return f"e AS (SELECT t, y AS x0, {lags}, lead(y, {horizon}) OVER (ORDER BY t) AS y_next FROM s), d AS (SELECT t, {', '.join(f'x{j}' for j in range(k + 1))}, y_next AS y FROM e WHERE t >= {k} AND y_next IS NOT NULL)"


#: The frame the resampling queries work on: the differenced series, embedded with four lags.
FRAME = f"{DIFF}, {embedded()}, {control_points('d')}, f AS (SELECT d.*, {phi()} AS phi FROM d, cp)"


def bumps(rule: str, threshold: str = "0.9") -> str:
    if rule == "over":
        cut, rare = f"(phi >= {threshold}) <> (before >= {threshold})", f"avg(phi) >= {threshold}"
    else:
        s = lambda p: f"(CASE WHEN {p} > {threshold} THEN -{p} ELSE {p} END)"
        cut, rare = f"{s('phi')} * {s('before')} < 0", f"avg(phi) > {threshold}"
    return f"""walk AS (SELECT *, lag(phi) OVER (ORDER BY y, t) AS before FROM f),
b AS (SELECT * EXCLUDE (before), CAST(sum(CASE WHEN {cut} THEN 1 ELSE 0 END) OVER (ORDER BY y, t ROWS UNBOUNDED PRECEDING) AS INTEGER) AS bump FROM walk),
k0 AS (SELECT bump, count(*) AS size, avg(phi) AS mean_phi, {rare} AS rare, avg(phi) < {threshold} AS normal FROM b GROUP BY bump),
tot AS (SELECT sum(CASE WHEN rare THEN size ELSE 0 END)::DOUBLE AS nr, sum(CASE WHEN normal THEN size ELSE 0 END)::DOUBLE AS nu, sum(CASE WHEN rare THEN 1 ELSE 0 END)::DOUBLE AS cr, sum(CASE WHEN normal THEN 1 ELSE 0 END)::DOUBLE AS cn, sum(size)::DOUBLE AS n, count(*)::DOUBLE AS nb FROM k0)"""


def targets(strategy: str) -> str:
    if strategy == "under":
        c = "CASE WHEN normal THEN round_even(CAST(nr / cn / size AS DOUBLE), 5) ELSE 1.0 END"
        out = "CASE WHEN size = 1 OR c >= 1 THEN size ELSE floor(c * size) END"
    elif strategy == "over":
        c = "CASE WHEN rare THEN round_even(CAST(nu / cr / size AS DOUBLE), 5) ELSE 0.0 END"
        out = "size + floor(c * size)"
    else:
        c = "round_even(CAST(n / nb AS DOUBLE), 0) / size"
        out = "CASE WHEN size = 1 OR c = 1 THEN size WHEN c < 1 THEN floor(c * size) ELSE size + floor(c - 1) * size + floor(size * (c - 1 - floor(c - 1))) END"
    return f"{bumps(strategy)}, k AS (SELECT *, CAST({out} AS BIGINT) AS n_out FROM (SELECT k0.*, CAST({c} AS DOUBLE) AS c FROM k0, tot))"


def u(stream: str, *key: str, seed: int = 42) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"((CAST(('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', {parts})), 1, 13)) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def weight(bias: str | None) -> str:
    if bias is None:
        return "(1.0::DOUBLE / size)"
    return "(rank::DOUBLE / size)" + (" * phi" if bias == "temporal+phi" else "")


RANKED = "r AS (SELECT b.*, k.size, k.n_out, k.rare, k.normal, row_number() OVER (PARTITION BY b.bump ORDER BY b.t) AS rank FROM b JOIN k ON b.bump = k.bump)"


def without(bias: str | None, out: str = "drawn") -> str:
    key = f"CASE WHEN {weight(bias)} > 0 THEN -ln({u('under', 'bump', 't')}) / ({weight(bias)}) ELSE ({u('under', 'bump', 't')} + 1.0) * 1e300 END"
    return f"{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bump ORDER BY key, t) AS take FROM (SELECT *, {key} AS key FROM r WHERE n_out < size)) WHERE take <= n_out)"


def replaced(bias: str | None, stream: str, n: str, where: str, out: str = "drawn") -> str:
    """Draws with replacement: ``n`` of each bump for which ``where`` holds."""
    asked = f"asked AS (SELECT bump, size, draw, {u(stream, 'bump', 'draw')} AS u FROM (SELECT bump, size, unnest(range(1, CAST({n} AS BIGINT) + 1)) AS draw FROM k WHERE {where}))"
    if bias != "temporal+phi":
        j = "floor(u * size) + 1" if bias is None else "floor((sqrt(1.0 + 4.0 * u * size::DOUBLE * (size::DOUBLE + 1.0)) - 1.0) / 2.0) + 1"
        return f"{asked}, hit AS (SELECT bump, draw, CAST(least(greatest({j}, 1), size) AS BIGINT) AS rank FROM asked), {out} AS (SELECT r.*, hit.draw FROM hit JOIN r ON r.bump = hit.bump AND r.rank = hit.rank)"
    cum = f"cum AS (SELECT bump, rank, sum({weight(bias)}) OVER (PARTITION BY bump ORDER BY rank ROWS UNBOUNDED PRECEDING) AS upto FROM r WHERE {weight(bias)} > 0)"
    points = "points AS (SELECT asked.bump, draw, u * top AS place FROM asked JOIN (SELECT bump, max(upto) AS top FROM cum GROUP BY bump) m ON m.bump = asked.bump)"
    hit = "hit AS (SELECT points.bump, draw, min(rank) AS rank FROM points JOIN cum ON cum.bump = points.bump AND cum.upto > points.place GROUP BY points.bump, draw)"
    return f"{asked}, {cum}, {points}, {hit}, {out} AS (SELECT r.*, hit.draw FROM hit JOIN r ON r.bump = hit.bump AND r.rank = hit.rank)"


def synthetic(bias: str | None, quirks: bool = True, features: int = 4, neighbours: int = 5) -> str:
    xs = [f"x{i}" for i in range(features)]
    search = "by_y" if bias is None and quirks else "by_t"
    read = "by_y" if quirks else "by_t"
    d = " + ".join(f"(a.{x} - c.{x}) * (a.{x} - c.{x})" for x in xs)
    ctes = f"""by_y AS (SELECT *, row_number() OVER (PARTITION BY bump ORDER BY y, t) - 1 AS pos FROM r WHERE n_out > size),
by_t AS (SELECT *, row_number() OVER (PARTITION BY bump ORDER BY t) - 1 AS pos FROM r WHERE n_out > size),
near AS (SELECT * FROM (SELECT bump, pos, nn, row_number() OVER (PARTITION BY bump, pos ORDER BY dist, nn) AS nn_rank FROM (SELECT a.bump, a.pos, c.pos AS nn, sqrt({d}) AS dist FROM {search} a JOIN {search} c ON a.bump = c.bump AND a.pos <> c.pos)) WHERE nn_rank <= {neighbours}),
many AS (SELECT bump, CAST(floor(c - 1) AS BIGINT) AS whole, CAST(floor(size * (c - 1 - floor(c - 1))) AS BIGINT) AS extra, least({neighbours}, size - 1) AS k_eff FROM k WHERE n_out > size),
seeds AS (SELECT o.bump, o.pos, many.k_eff, many.whole + CASE WHEN row_number() OVER (PARTITION BY o.bump ORDER BY {u('extra', 'o.bump', 'o.pos')}, o.pos) <= many.extra THEN 1 ELSE 0 END AS copies FROM {search} o JOIN many ON many.bump = o.bump),
plan AS (SELECT bump, pos, k_eff, unnest(range(1, copies + 1)) AS copy FROM seeds WHERE copies > 0)"""
    if bias is None:
        pick = f"picked AS (SELECT p.bump, p.pos, p.copy, near.nn AS nn_pos FROM plan p JOIN near ON near.bump = p.bump AND near.pos = p.pos AND near.nn_rank = least(floor({u('pick', 'p.bump', 'p.pos', 'p.copy')} * p.k_eff) + 1, p.k_eff))"
    else:
        score = "nn" if bias == "temporal" else "score"
        chosen = "near" if bias == "temporal" else "(SELECT near.*, (near.nn + 1.0::DOUBLE) / (max(near.nn) OVER (PARTITION BY near.bump, near.pos) + 1.0::DOUBLE) * by_t.phi AS score FROM near JOIN by_t ON by_t.bump = near.bump AND by_t.pos = near.nn)"
        pick = f"chosen AS (SELECT bump, pos, nn FROM (SELECT *, row_number() OVER (PARTITION BY bump, pos ORDER BY {score} DESC, nn_rank) AS first FROM {chosen} q) WHERE first = 1), picked AS (SELECT p.bump, p.pos, p.copy, chosen.nn AS nn_pos FROM plan p JOIN chosen ON chosen.bump = p.bump AND chosen.pos = p.pos)"
    new = ", ".join(f"a.{x} + l * (c.{x} - a.{x}) AS {x}" for x in xs)
    used = xs[:1] if quirks else xs
    dist = (lambda s: f"abs({s}_x0 - x0)") if quirks else (lambda s: "sqrt(" + " + ".join(f"({s}_{x} - {x}) * ({s}_{x} - {x})" for x in xs) + ")")
    carried = ", ".join(f"a.{x} AS a_{x}, c.{x} AS c_{x}" for x in used)
    return f"""{ctes}, {pick},
mixed AS (SELECT g.bump, g.pos, g.copy, g.nn_pos, a.t AS seed_t, a.y AS ya, c.y AS yc, {carried}, {new} FROM (SELECT *, {u('lambda', 'bump', 'pos', 'copy')} AS l FROM picked) g JOIN {read} a ON a.bump = g.bump AND a.pos = g.pos JOIN {read} c ON c.bump = g.bump AND c.pos = g.nn_pos),
made AS (SELECT *, CASE WHEN d1 = d2 THEN (ya + yc) / 2.0 ELSE (d2 * ya + d1 * yc) / (d1 + d2) END AS y FROM (SELECT *, {dist('a')} AS d1, {dist('c')} AS d2 FROM mixed))"""


def _rows(src: str, origin: str, seq: str, t: str = "t", where: str = "") -> str:
    return f"SELECT CAST({t} AS BIGINT) AS t, round(x0, 6) AS x0, round(x3, 6) AS x3, round(y, 6) AS y, '{origin}' AS origin, CAST({seq} AS BIGINT) AS seq FROM {src} {where}"


def resampled(strategy: str, bias: str | None, quirks: bool = True) -> str:
    head = f"WITH {FRAME}, {targets(strategy)}, {RANKED}, "
    if strategy == "under":
        return head + without(bias) + " " + _rows("r", "original", "0", where="WHERE n_out >= size") + " UNION ALL " + _rows("drawn", "original", "0")
    if strategy == "over":
        return head + replaced(bias, "over", "n_out - size", "n_out > size") + " " + _rows("r", "original", "0") + " UNION ALL " + _rows("drawn", "copy", "draw")
    return head + replaced(bias, "smote_under", "n_out", "n_out < size") + ", " + synthetic(bias, quirks) + " " + _rows("r", "original", "0", where="WHERE n_out >= size") + " UNION ALL " + _rows("drawn", "copy", "draw") + " UNION ALL " + _rows("made", "synthetic", "copy", "seed_t")


def summary(src: str = "s", y: str = "y", prefix: str = "") -> str:
    return f"SELECT {prefix}count(*) AS N, CAST(sum(CASE WHEN p >= 0.9 THEN 0 ELSE 1 END) AS BIGINT) AS n_normal, CAST(sum(CASE WHEN p >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS n_rare, round(sum(CASE WHEN p >= 0.9 THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN p >= 0.9 THEN 0 ELSE 1 END), 6) AS IR, round(100.0::DOUBLE * sum(CASE WHEN p >= 0.9 THEN 1 ELSE 0 END) / count(*), 6) AS pct_rare FROM (SELECT {phi(y)} AS p FROM {src}, cp)"


CP_OUT = "SELECT round(x_lo, 6) AS x_lo, p_lo, round(med, 6) AS med, round(x_hi, 6) AS x_hi, p_hi FROM cp"


def by_type() -> str:
    """Control points of each event type."""
    pick = lambda d: f"(0.5 * (max(CASE WHEN rn = floor({d}) THEN y END) + max(CASE WHEN rn = ceil({d}) THEN y END)))"
    return f"""o AS (SELECT event_type, value AS y, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
o2 AS (SELECT *, floor((n + 3) / 2) / 2 AS d1, (n + 1) / 2 AS d2, n + 1 - floor((n + 3) / 2) / 2 AS d3 FROM o),
h AS (SELECT event_type, max(n) AS n, {pick('d1')} AS q1, {pick('d2')} AS med, {pick('d3')} AS q3 FROM o2 GROUP BY event_type),
x AS (SELECT o.event_type, max(h.n) AS n, max(q1) AS q1, max(med) AS med, max(q3) AS q3, min(y) AS a, max(y) AS b, min(CASE WHEN y >= q1 - 1.5 * (q3 - q1) THEN y END) AS lw, max(CASE WHEN y <= q3 + 1.5 * (q3 - q1) THEN y END) AS uw FROM o JOIN h ON o.event_type = h.event_type GROUP BY o.event_type),
cp AS (SELECT event_type, n, q1, q3, CASE WHEN a < lw THEN lw ELSE a END AS x_lo, CASE WHEN a < lw THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_lo, med, CASE WHEN b > uw THEN uw ELSE b END AS x_hi, CASE WHEN b > uw THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_hi FROM x)"""


def scored() -> str:
    """The frame with the forecast x0 and the utility of both-sided control points."""
    share = lambda limit: f"(CASE WHEN loss < ({limit}) THEN loss / ({limit}) ELSE 1.0 END)"
    inf = "'inf'::DOUBLE"
    lb = f"CASE WHEN y < med THEN least(d0, CASE WHEN x0 < y THEN {inf} ELSE abs(y - med) END) ELSE least(d1, CASE WHEN x0 < y THEN abs(y - med) ELSE {inf} END) END"
    lc = f"CASE WHEN y < med THEN least(d0, CASE WHEN x0 < y THEN {inf} ELSE abs(y - x_hi) END) ELSE least(d1, CASE WHEN x0 < y THEN abs(y - x_lo) ELSE {inf} END) END"
    return f"{FRAME}, g AS (SELECT f.*, x_lo, med, x_hi, {phi('x0')} AS phi_hat, abs(x0 - y) AS loss, 2 * abs(x_lo - med) AS d0, 2 * abs(med - x_hi) AS d1 FROM f, cp), v AS (SELECT t, x0, y, phi, phi_hat, loss, phi * (1 - {share(lb)}) - (0.5 * phi_hat + 0.5 * phi) * {share(lc)} AS u FROM g)"


RECALL = "coalesce(sum(CASE WHEN phi >= 0.9 THEN abs(1 + u) END) / sum(CASE WHEN phi >= 0.9 THEN abs(1 + phi) END), 0.00001)"
PRECISION = "coalesce(sum(CASE WHEN phi_hat >= 0.9 THEN abs(1 + u) END) / sum(CASE WHEN phi_hat >= 0.9 THEN abs(1 + phi_hat) END), 0.00001)"
GRID = "grid AS (SELECT i, i / 1000.0::DOUBLE AS t FROM (SELECT unnest(range(0, 1001)) AS i)), cells AS (SELECT CAST(floor(phi * 1000) AS BIGINT) + CASE WHEN (floor(phi * 1000) + 1) * 0.001::DOUBLE <= phi THEN 1 ELSE 0 END - CASE WHEN floor(phi * 1000) * 0.001::DOUBLE > phi THEN 1 ELSE 0 END AS i, sum((y - x0) * (y - x0)) AS e FROM v GROUP BY 1), curve AS (SELECT grid.i, grid.t, sum(coalesce(e, 0)) OVER (ORDER BY grid.i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ser FROM grid LEFT JOIN cells ON cells.i = grid.i)"


def windows(n: str, reps: int = 50, seed: int = 7) -> str:
    start = f"CAST(floor({u('split', 'i', seed=seed)} * (n - n_tr - n_te + 1)) AS BIGINT)"
    return f"w AS (SELECT CAST(i AS INTEGER) AS split, a, a + n_tr AS b, a + n_tr + n_te AS e FROM (SELECT i, {start} AS a, n_tr, n_te FROM (SELECT n, CAST(floor(0.5 * n) AS BIGINT) AS n_tr, CAST(floor(0.25 * n) AS BIGINT) AS n_te FROM (SELECT {n} AS n)), (SELECT unnest(range(0, {reps})) AS i)))"


def _prefs(bias: str | None) -> str:
    return f"WITH {FRAME}, {targets('under')}, {RANKED} SELECT t, bump, rank, round(w / sum(w) OVER (PARTITION BY bump), 9) AS p FROM (SELECT t, bump, rank, {weight(bias)} AS w FROM r)"


def _sources() -> dict[str, str]:
    v = "printf('%.3f', value)"
    spelled = [v, f"'  ' || {v} || ' '", f"{v} || 'e2'", f"'+' || {v}", f"{v} || 'd'", "'1,234'", "'NA'", "'0x1F'", f"{v} || 'f'", "'.5'"]
    numbers = {0: f"CAST({v} AS DOUBLE)", 1: f"CAST({v} AS DOUBLE)", 2: f"CAST({v} AS DOUBLE) * 100", 3: f"CAST({v} AS DOUBLE)", 9: "0.5::DOUBLE"}
    assert len(spelled) == 10
    day, t = "date_trunc('day', CAST(ts AS TIMESTAMP))", "CAST(ts AS TIMESTAMP)"
    at = f"CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 5 = 1 THEN date_trunc('second', {t}) WHEN event_id % 5 = 3 THEN date_trunc('minute', {t}) ELSE {day} END"
    gaps = "g AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS t, value AS y FROM events WHERE event_id % 97 <> 13)"
    later = "s AS (SELECT t, y FROM (SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS t, {y} AS y FROM {src}) WHERE t >= {k})"
    tables = []
    for ident, name, unit, threshold, spec in (("A", "values", "", "0.9", {"order": "ts, event_id", "y": "value", "src": "events", "k": 0}), ("B", "later values", "s", "0.8", {"order": "ts, event_id", "y": "value", "src": "events", "k": 10}), ("C", "lengths", "", "0.9", {"order": "doc_id", "y": "n_chars::DOUBLE", "src": "documents", "k": 4})):
        one = summary().replace("0.9", threshold)
        tables.append(f"SELECT '{ident}' AS id, '{name}' AS dataset, N, '{unit}' AS granularity, n_normal, n_rare, round(IR, 2) AS IR, round(pct_rare, 2) AS pct_rare FROM (WITH {later.format(**spec)}, {control_points()} {one})")
    return {
        "strict_numbers": f"SELECT event_id, event_id % 10 = 6 AS missing, round(CASE event_id % 10 {' '.join(f'WHEN {i} THEN {x}' for i, x in numbers.items())} END, 6) AS y FROM events",
        "date_order": f"SELECT event_id, CAST(row_number() OVER (ORDER BY {at} NULLS LAST, event_id) - 1 AS BIGINT) AS t FROM events",
        "csv_series": f"WITH {gaps} SELECT CAST(t - 2 AS BIGINT) AS t, round(step, 6) AS y FROM (SELECT t, y - lag(y) OVER (ORDER BY t) AS step FROM g) WHERE t > 1",
        "csv_manifest": " UNION ALL ".join(tables),
    }


REFUSED = ("embed: k", "embed: horizon", "embed: too short", "embed: missing value", "under with o", "over with u", "over below 1", "negative u", "unknown strategy", "unknown bias", "k of neighbours", "unknown parameter", "two control points", "a slope", "phi above 1", "relevance by name", "metric of a column", "metric of missing values", "sera: step", "imputation by name", "gaps refused", "splits: too long", "splits: empty window", "command line: no source", "command line: coef", "command line: one end", "command line: k")


def _forms() -> dict[str, str]:
    given = "cp AS (SELECT 20.0::DOUBLE AS x_lo, 1.0::DOUBLE AS p_lo, 50.0::DOUBLE AS med, 120.0::DOUBLE AS x_hi, 0.5::DOUBLE AS p_hi)"
    sizes = []
    for strategy, o, u in (("under", None, 0.3), ("over", 1.7, None), ("smote", 2.6, 0.45), ("smote", 3.25, None), ("smote", None, 0.2)):
        still = "0.0" if strategy == "over" else "1.0"
        c = f"CASE WHEN rare THEN {o if o is not None else still} WHEN normal THEN {u if u is not None else still} ELSE {still} END"
        if strategy == "over":
            n = "size + floor(c * size)"
        else:
            n = "CASE WHEN size = 1 OR c = 1 THEN size WHEN c < 1 THEN floor(c * size) ELSE size + floor(c - 1) * size + floor(size * (c - 1 - floor(c - 1))) END"
        lit = lambda x: "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"
        sizes.append(f"(WITH {FRAME}, {bumps(strategy)} SELECT bump, size, c, CAST({n} AS BIGINT) AS n_out, '{strategy}' AS strategy, {lit(o)} AS o, {lit(u)} AS u FROM (SELECT *, CAST({c} AS DOUBLE) AS c FROM k0))")
    w = "CASE WHEN bump = (SELECT min(bump) FROM k0) THEN 0.0 ELSE rank::DOUBLE / size * phi END"
    # every split's own control points: ranks within its training window
    pick = lambda d: f"(0.5 * (max(CASE WHEN rn = floor({d}) THEN y END) + max(CASE WHEN rn = ceil({d}) THEN y END)))"
    share = lambda limit: f"(CASE WHEN loss < ({limit}) THEN loss / ({limit}) ELSE 1.0 END)"
    two = "p_lo > 0 AND p_hi > 0"
    parting = f"CASE WHEN {two} THEN med WHEN p_lo > 0 THEN (med + x_hi) / 2 ELSE (x_lo + med) / 2 END"
    low = f"CASE WHEN {two} THEN 2 * abs(med - x_lo) WHEN p_lo > 0 THEN 2 * abs(part_at - x_lo) ELSE 2 * abs(x_hi - part_at) END"
    high = f"CASE WHEN {two} THEN 2 * abs(x_hi - med) WHEN p_lo > 0 THEN 2 * abs(part_at - x_lo) ELSE 2 * abs(x_hi - part_at) END"
    near = "CASE WHEN y < part_at THEN CASE WHEN x0 >= y THEN least(low, abs(y - part_at)) ELSE low END ELSE CASE WHEN x0 < y THEN least(high, abs(y - part_at)) ELSE high END END"
    far = f"CASE WHEN y < part_at THEN CASE WHEN x0 >= y AND p_hi > 0 OR x0 >= y AND NOT p_lo > 0 THEN least(low, abs(y - x_hi)) ELSE low END ELSE CASE WHEN x0 < y AND p_lo > 0 THEN least(high, abs(y - x_lo)) ELSE high END END"
    sera = "sum((y - x0) * (y - x0) * CASE WHEN m >= 1001 THEN 1.0 ELSE (m - 0.5) / 1000.0 END) / 1000.0"
    persistence = f"""WITH {DIFF}, {embedded()}, d0 AS (SELECT *, CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS idx FROM d), {windows('(SELECT count(*) FROM d)')},
o AS (SELECT split, y, row_number() OVER (PARTITION BY split ORDER BY y) AS rn, count(*) OVER (PARTITION BY split) AS n FROM d0 JOIN w ON idx >= a AND idx < b),
o2 AS (SELECT *, floor((n + 3) / 2) / 2 AS d1, (n + 1) / 2 AS d2, n + 1 - floor((n + 3) / 2) / 2 AS d3 FROM o),
h AS (SELECT split, {pick('d1')} AS q1, {pick('d2')} AS med, {pick('d3')} AS q3 FROM o2 GROUP BY split),
x AS (SELECT o.split, max(med) AS med, min(y) AS a, max(y) AS b, min(CASE WHEN y >= q1 - 1.5 * (q3 - q1) THEN y END) AS lw, max(CASE WHEN y <= q3 + 1.5 * (q3 - q1) THEN y END) AS uw FROM o JOIN h ON o.split = h.split GROUP BY o.split),
cps AS (SELECT split, CASE WHEN a < lw THEN lw ELSE a END AS x_lo, CASE WHEN a < lw THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_lo, med, CASE WHEN b > uw THEN uw ELSE b END AS x_hi, CASE WHEN b > uw THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_hi FROM x),
q AS (SELECT cps.*, d0.x0, d0.y, {parting} AS part_at FROM d0 JOIN w ON idx >= b AND idx < e JOIN cps ON cps.split = w.split),
r AS (SELECT *, {phi()} AS phi, {phi('x0')} AS phi_hat, abs(x0 - y) AS loss, {low} AS low, {high} AS high FROM q),
v AS (SELECT *, phi * (1 - {share(near)}) - (0.5 * phi_hat + 0.5 * phi) * {share(far)} AS u, floor(phi * 1000) + 1 + CASE WHEN (floor(phi * 1000) + 1) * 0.001::DOUBLE <= phi THEN 1 ELSE 0 END - CASE WHEN floor(phi * 1000) * 0.001::DOUBLE > phi THEN 1 ELSE 0 END AS m FROM r),
z AS (SELECT split, {RECALL} AS recall_phi, {PRECISION} AS precision_phi, {sera} AS sera FROM v GROUP BY split)
SELECT 'baseline' AS strategy, split, metric, round(value, 4) AS value FROM (SELECT split, 'recall_phi' AS metric, recall_phi AS value FROM z UNION ALL SELECT split, 'precision_phi', precision_phi FROM z UNION ALL SELECT split, 'sera', sera FROM z UNION ALL SELECT split, 'f1_phi', 2 * precision_phi * recall_phi / (precision_phi + recall_phi) FROM z)"""
    return {
        "phi_given": f"WITH s AS (SELECT event_id AS t, value::DOUBLE AS y FROM events), {given} SELECT t, round({phi()}, 6) AS by_rows, round(y / (abs(y) + 100.0::DOUBLE) * 0.5 + 0.5, 6) AS by_column, CASE WHEN y > 60 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS by_function FROM s, cp",
        "prefs_no_weight": f"WITH {FRAME}, {targets('under')}, {RANKED} SELECT t, bump, round(CASE WHEN total > 0 THEN w / total ELSE 1.0::DOUBLE / size END, 9) AS p FROM (SELECT *, sum(w) OVER (PARTITION BY bump) AS total FROM (SELECT *, {w} AS w FROM r))",
        "bump_targets_given": " UNION ALL ".join(sizes),
        "refusals": " UNION ALL ".join(f"SELECT '{x}' AS \"case\", true AS refused" for x in REFUSED) + " UNION ALL SELECT 'nothing is wrong', false",
        "evaluate_persistence": persistence,
    }


def sql() -> dict[str, str]:
    tied = "s AS (SELECT event_id AS t, CASE WHEN event_id % 5 = 0 THEN value ELSE 1.0::DOUBLE END AS y FROM events)"
    out = {
        "series_index": f"WITH {VALUE} SELECT t, round(y, 6) AS y FROM s",
        "first_difference": f"WITH {DIFF} SELECT t, round(y, 6) AS y FROM s",
        "tukey_hinges": f"WITH {VALUE}, {control_points()} SELECT round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3 FROM hinge",
        "control_points_one_sided": f"WITH {VALUE}, {control_points()} {CP_OUT}",
        "control_points_two_sided": f"WITH {DIFF}, {control_points()} {CP_OUT}",
        "control_points_by_type": f"WITH {by_type()} SELECT event_type, n, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3, round(x_lo, 6) AS x_lo, p_lo, round(x_hi, 6) AS x_hi, p_hi FROM cp",
        "phi_scores": f"WITH {DIFF}, {control_points()} SELECT t, round({phi()}, 6) AS phi, {phi()} >= 0.9 AS rare FROM s, cp",
        "phi_tied_knots": f"WITH {tied}, {control_points()} SELECT t, round({phi()}, 6) AS phi FROM s, cp",
        "imbalance_summary": f"WITH {VALUE}, {control_points()} {summary()}",
        "imbalance_summary_by_type": f"WITH {by_type()} SELECT event_type, count(*) AS N, CAST(sum(CASE WHEN p >= 0.9 THEN 0 ELSE 1 END) AS BIGINT) AS n_normal, CAST(sum(CASE WHEN p >= 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS n_rare, round(sum(CASE WHEN p >= 0.9 THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN p >= 0.9 THEN 0 ELSE 1 END), 6) AS IR, round(100.0::DOUBLE * sum(CASE WHEN p >= 0.9 THEN 1 ELSE 0 END) / count(*), 6) AS pct_rare FROM (SELECT events.event_type, {phi('value')} AS p FROM events JOIN cp ON events.event_type = cp.event_type) GROUP BY event_type",
        "imbalance_no_rare": f"WITH s AS (SELECT o_totalprice AS y FROM orders), {control_points()} {summary()}",
        "embed_k8": f"WITH {VALUE}, {embedded(8)} SELECT t, {', '.join(f'round(x{i}, 6) AS x{i}' for i in range(9))}, round(y, 6) AS y FROM d",
        "embed_horizon3_exog": f"WITH s AS (SELECT CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value AS y, user_id FROM events), e AS (SELECT t, y AS x0, lag(y, 1) OVER (ORDER BY t) AS x1, lag(y, 2) OVER (ORDER BY t) AS x2, user_id, lead(y, 3) OVER (ORDER BY t) AS y_next FROM s) SELECT t, round(x0, 6) AS x0, round(x1, 6) AS x1, round(x2, 6) AS x2, user_id, round(y_next, 6) AS y FROM e WHERE t >= 2 AND y_next IS NOT NULL",
        "impute_drop": f"WITH {GAPS} SELECT CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS t, round(y, 6) AS y FROM s WHERE y IS NOT NULL",
        "knn_neighbours": f"WITH {FRAME}, {bumps('over')}, by_y AS (SELECT b.*, row_number() OVER (PARTITION BY b.bump ORDER BY y, t) - 1 AS pos FROM b JOIN k0 ON k0.bump = b.bump AND k0.rare) SELECT bump, pos, nn_rank, nn FROM (SELECT bump, pos, nn, CAST(row_number() OVER (PARTITION BY bump, pos ORDER BY dist, nn) AS INTEGER) AS nn_rank FROM (SELECT a.bump, a.pos, c.pos AS nn, sqrt({' + '.join(f'(a.x{i} - c.x{i}) * (a.x{i} - c.x{i})' for i in range(4))}) AS dist FROM by_y a JOIN by_y c ON a.bump = c.bump AND a.pos <> c.pos)) WHERE nn_rank <= 5",
        "synthetic_cases": f"WITH {FRAME}, {targets('smote')}, {RANKED}, {synthetic('temporal')} SELECT bump, pos, CAST(copy AS INTEGER) AS copy, nn_pos, seed_t, round(x0, 6) AS x0, round(y, 6) AS y FROM made",
        "smote_tphi_no_quirks": resampled("smote", "temporal+phi", False),
        "utility_scores": f"WITH {scored()} SELECT t, round(u, 6) AS u FROM v",
        "recall_phi": f"WITH {scored()} SELECT round({RECALL}, 6) AS recall_phi FROM v",
        "precision_phi": f"WITH {scored()} SELECT round({PRECISION}, 6) AS precision_phi FROM v",
        "f1_phi": f"WITH {scored()} SELECT round(2 * p * r / (p + r), 6) AS f1_phi FROM (SELECT {RECALL} AS r, {PRECISION} AS p FROM v)",
        "sera": f"WITH {scored()}, {GRID} SELECT round(sum((ser + ahead) / 2 * 0.001) / 1000.0, 4) AS sera_thousands FROM (SELECT ser, lead(ser) OVER (ORDER BY i) AS ahead FROM curve) WHERE ahead IS NOT NULL",
        "sera_curve": f"WITH {scored()}, {GRID} SELECT t, round(ser, 2) AS ser FROM curve",
        "temporal_splits": f"WITH {windows('(SELECT count(*) FROM events)')} SELECT split, a, b, e FROM w",
        "split_windows": f"WITH {VALUE}, {windows('(SELECT count(*) FROM events)')} SELECT split, CASE WHEN t < b THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(t) AS first_t, max(t) AS last_t, round(avg(y), 6) AS mean_y FROM s JOIN w ON t >= a AND t < e GROUP BY 1, 2",
        "resample_noop": "SELECT o_orderkey AS t, round(o_totalprice, 6) AS y, 'original' AS origin FROM orders",
        "table1_manifest": " UNION ALL ".join(
            f"SELECT id, dataset, N, n_normal, n_rare, round(IR, 2) AS IR, round(pct_rare, 2) AS pct_rare FROM ({cte} {summary()})".replace("SELECT id, dataset", f"SELECT '{i}' AS id, '{name}' AS dataset", 1)
            for i, name, cte in (("E1", "events.value", f"WITH {VALUE}, {control_points()}"), ("E2", "events.value differenced", f"WITH {DIFF}, {control_points()}"), ("D1", "documents.n_chars", f"WITH s AS (SELECT doc_id AS t, n_chars::DOUBLE AS y FROM documents), {control_points()}"))
        ),
    }
    out |= _sources() | _forms()
    for rule in ("over", "under"):
        out[f"bumps_{rule}"] = f"WITH {FRAME}, {bumps(rule)} SELECT bump, size, round(mean_phi, 6) AS mean_phi, rare, normal FROM k0"
    for strategy in ("under", "over", "smote"):
        out[f"bump_targets_{strategy}"] = f"WITH {FRAME}, {targets(strategy)} SELECT bump, size, rare, normal, round(c, 6) AS c, n_out FROM k"
        for bias, suffix in ((None, "b"), ("temporal", "t"), ("temporal+phi", "tphi")):
            out[f"{strategy}_{suffix}"] = resampled(strategy, bias)
    for bias, name in ((None, "uniform"), ("temporal", "temporal"), ("temporal+phi", "temporal_phi")):
        out[f"prefs_{name}"] = _prefs(bias)
    draws = f"WITH {FRAME}, {targets('under')}, {RANKED}, "
    out["draw_without_replacement"] = draws + without("temporal") + " SELECT bump, t FROM drawn"
    out["draw_with_replacement"] = f"WITH {FRAME}, {targets('over')}, {RANKED}, {replaced('temporal', 'over', 'n_out - size', 'n_out > size')} SELECT bump, draw, rank, t FROM drawn"
    half = without("temporal+phi").replace("n_out", "asked_n").replace("FROM r WHERE asked_n < size", "FROM (SELECT r.*, size - 1 AS asked_n FROM r) WHERE normal")
    out["draw_topup"] = draws + half + " SELECT bump, t FROM drawn"
    return out
