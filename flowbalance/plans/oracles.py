"""The catalogue's queries as plain SQL for an independent engine.

Written from the formulas, not from the operators. Sums add micro units (1e-6) as integers, as the
library does. Literals carry an exponent where they have to be DOUBLE.
"""

from __future__ import annotations

CHEESES = "['cheddar', 'mozzarella', 'swiss', 'parmesan']"
POWDERS = "['nfdm', 'bmp', 'wmp']"
PRODUCTS = ["butter", "nfdm", "bmp", "wmp", "cheddar", "mozzarella", "swiss", "parmesan", "whey"]

# Recipes and market parameters.
RECIPES = """recipes(cheese, moisture, fat_rec, cf_ratio, cas_rec) AS (VALUES
 ('cheddar', 0.37e0, 0.90e0, 0.68e0, 0.75e0), ('mozzarella', 0.47e0, 0.85e0, 0.95e0, 0.75e0),
 ('swiss', 0.38e0, 0.88e0, 0.80e0, 0.75e0), ('parmesan', 0.30e0, 0.88e0, 1.20e0, 0.75e0))"""
MARKET = """market(ord, product, base, demand, elast) AS (VALUES
 (0, 'butter', 2.50e0, 100e0, 0.3e0), (1, 'nfdm', 1.20e0, 80e0, 0.3e0),
 (2, 'bmp', 1.40e0, 30e0, 0.3e0), (3, 'wmp', 1.80e0, 50e0, 0.3e0),
 (4, 'cheddar', 1.80e0, 120e0, 0.3e0), (5, 'mozzarella', 1.90e0, 100e0, 0.3e0),
 (6, 'swiss', 2.20e0, 40e0, 0.3e0), (7, 'parmesan', 3.50e0, 30e0, 0.3e0),
 (8, 'whey', 0.40e0, 200e0, 0.2e0))"""

LOTS = f"""lots AS (SELECT l_orderkey AS order_key, l_linenumber AS line_number,
 l_partkey AS part_key, l_suppkey AS site,
 l_quantity * 100e0 AS volume, 3e0 + l_discount * 20e0 AS fat_pct, 7.5e0 + l_tax * 25e0 AS snf_pct,
 {CHEESES}[1 + l_partkey % 4] AS cheese_type, {POWDERS}[1 + l_suppkey % 3] AS powder_type,
 CAST(30 + l_partkey % 16 AS DOUBLE) AS cream_fat_pct,
 CAST(78 + l_suppkey % 7 AS DOUBLE) AS butter_fat_pct,
 CAST(5 * (l_orderkey % 21) AS DOUBLE) AS skim_split_pct,
 CAST(5 * (l_partkey % 21) AS DOUBLE) AS cream_split_pct,
 {CHEESES}[1 + l_partkey % 4] AS cheese_a, {CHEESES}[1 + l_orderkey % 4] AS cheese_b,
 CAST(78 + l_suppkey % 7 AS DOUBLE) AS butter_a_fat_pct,
 CAST(78 + l_partkey % 7 AS DOUBLE) AS butter_b_fat_pct,
 {POWDERS}[1 + l_suppkey % 3] AS powder_a, {POWDERS}[1 + l_linenumber % 3] AS powder_b
 FROM lineitem)"""


def u(x: str) -> str:
    return f"CAST(round_even(({x}) * 1e6, 0) AS BIGINT)"


def s(x: str, where: str = "") -> str:
    condition = f" FILTER (WHERE {where})" if where else ""
    return f"(CAST(coalesce(SUM({u(x)}){condition}, 0) AS DOUBLE) / 1e6)"


def r(x: str, digits: int = 6) -> str:
    return f"(round_even(({x}) * 1e{digits}, 0) / 1e{digits})"


def sums(prefix: str = "") -> str:
    return ", ".join(f"{s(prefix + m)} AS {m}" for m in ("volume", "fat", "snf", "water"))


MILK = f"""{LOTS}, milk AS (SELECT *, volume * (fat_pct / 100e0) AS fat,
 volume * (snf_pct / 100e0) AS snf, volume - volume * (fat_pct / 100e0) - volume * (snf_pct / 100e0)
 AS water FROM lots)"""

# Cream and skim of every lot, wide then long.
SEPARATED = f"""{MILK}, sep1 AS (SELECT *, cream_fat_pct / 100e0 AS goal,
 volume * (fat / volume - 0.001e0) / (cream_fat_pct / 100e0 - 0.001e0) AS cv FROM milk),
sep2 AS (SELECT *, cv * goal AS cf, snf * (cv / volume) AS cs FROM sep1),
sep3 AS (SELECT *, cv - cf - cs AS cw, volume - cv AS kv, fat - cf AS kf, snf - cs AS ks FROM sep2),
sep4 AS (SELECT *, kv - kf - ks AS kw FROM sep3),
split AS (
 SELECT site, powder_type, butter_fat_pct, 'cream' AS kind, cv AS volume, cf AS fat, cs AS snf,
  cw AS water FROM sep4
 UNION ALL SELECT site, powder_type, butter_fat_pct, 'skim', kv, kf, ks, kw FROM sep4)"""

# Whole milk through the cheese recipes.
CURDLED = f"""{MILK}, {RECIPES}, cur1 AS (SELECT *, snf * 0.296e0 AS casein,
 least(snf * 0.296e0 / cf_ratio, fat) AS used FROM milk JOIN recipes ON cheese = cheese_type),
cur2 AS (SELECT *, used * fat_rec AS cf, casein * cas_rec AS cs, fat - used AS surplus FROM cur1),
cur3 AS (SELECT *, (cf + cs) / (1e0 - moisture) AS cv FROM cur2),
cur4 AS (SELECT *, cv - (cf + cs) AS cw FROM cur3),
cur5 AS (SELECT *, used - cf AS wf, snf - cs AS ws, water - cw AS ww,
 CASE WHEN surplus > 0.001e0 THEN surplus ELSE 0e0 END AS ex FROM cur4),
curd AS (
 SELECT site, cheese_type, 'cheese' AS kind, cv AS volume, cf AS fat, cs AS snf, cw AS water FROM cur5
 UNION ALL SELECT site, cheese_type, 'whey', wf + ws + ww, wf, ws, ww FROM cur5
 UNION ALL SELECT site, cheese_type, 'excess_cream', ex, ex, 0e0, 0e0 FROM cur5)"""


def _cheese(x: str) -> str:
    return f"""
q{x}1 AS (SELECT p.*, p.sn{x} * 0.296e0 AS cas{x}, least(p.sn{x} * 0.296e0 / r.cf_ratio, p.fa{x}) AS used{x},
 r.moisture AS mo{x}, r.fat_rec AS fr{x}, r.cas_rec AS cr{x}
 FROM {'p2' if x == 'a' else 'qa4'} p JOIN recipes r ON r.cheese = p.cheese_{x}),
q{x}2 AS (SELECT *, used{x} * fr{x} AS chf{x}, cas{x} * cr{x} AS chs{x},
 CASE WHEN fa{x} - used{x} > 0.001e0 THEN fa{x} - used{x} ELSE 0e0 END AS ex{x} FROM q{x}1),
q{x}3 AS (SELECT *, (chf{x} + chs{x}) / (1e0 - mo{x}) AS chv{x} FROM q{x}2),
q{x}4 AS (SELECT *, chv{x} - (chf{x} + chs{x}) AS chw{x}, used{x} - chf{x} AS whf{x},
 sn{x} - chs{x} AS whs{x}, wa{x} - (chv{x} - (chf{x} + chs{x})) AS whw{x} FROM q{x}3)"""


def _butter(x: str) -> str:
    return f"""
b{x}1 AS (SELECT *, pf{x} * 0.99e0 AS bf0{x}, pf{x} * 0.99e0 / (butter_{x}_fat_pct / 100e0) AS bv0{x}
 FROM {'pool2' if x == 'a' else 'ba3'}),
b{x}2 AS (SELECT *, bv0{x} * 0.015e0 AS bs{x}, bv0{x} - bf0{x} - bv0{x} * 0.015e0 AS bw{x},
 CASE WHEN powder_{x} = 'wmp' THEN (0.26e0 * (pv{x} - bv0{x}) - (pf{x} - bf0{x})) / (1e0 - 0.26e0)
 ELSE 0e0 END AS x{x} FROM b{x}1),
b{x}3 AS (SELECT *, bv0{x} - x{x} AS bv{x}, bf0{x} - x{x} AS bf{x}, (pv{x} - bv0{x}) + x{x} AS dv{x},
 (pf{x} - bf0{x}) + x{x} AS df{x}, ps{x} - bs{x} AS ds{x}, pw{x} - bw{x} AS dw{x} FROM b{x}2)"""


def plant(source: str) -> str:
    """CTEs from a table of configurations to one wide row per configuration (``ba3`` then b)."""
    return f"""{RECIPES},
m1 AS (SELECT *, volume * (fat_pct / 100e0) AS fat, volume * (snf_pct / 100e0) AS snf FROM {source}),
m2 AS (SELECT *, volume - fat - snf AS water,
 volume * (fat / volume - 0.001e0) / (cream_fat_pct / 100e0 - 0.001e0) AS cv FROM m1),
m3 AS (SELECT *, cv * (cream_fat_pct / 100e0) AS cf, snf * (cv / volume) AS cs FROM m2),
m4 AS (SELECT *, cv - cf - cs AS cw, volume - cv AS kv, fat - cf AS kf, snf - cs AS ks FROM m3),
p1 AS (SELECT *, kv - kf - ks AS kw, skim_split_pct / 100e0 AS sa, 1e0 - skim_split_pct / 100e0 AS sb
 FROM m4),
p2 AS (SELECT *, kv * sa AS voa, kf * sa AS faa, ks * sa AS sna, kw * sa AS waa,
 kv * sb AS vob, kf * sb AS fab, ks * sb AS snb, kw * sb AS wab FROM p1),{_cheese('a')},{_cheese('b')},
pool1 AS (SELECT *, cv + exa + exb AS pv, cf + exa + exb AS pf, cs + 0e0 + 0e0 AS ps,
 cw + 0e0 + 0e0 AS pw, cream_split_pct / 100e0 AS ta, 1e0 - cream_split_pct / 100e0 AS tb FROM qb4),
pool2 AS (SELECT *, pv * ta AS pva, pf * ta AS pfa, ps * ta AS psa, pw * ta AS pwa,
 pv * tb AS pvb, pf * tb AS pfb, ps * tb AS psb, pw * tb AS pwb FROM pool1),{_butter('a')},{_butter('b')}"""


# from, to, kind, product, volume, fat, snf, water
_EDGES = [
    ("producer", "separator", "milk", "NULL", "volume", "fat", "snf", "water"),
    ("separator", "pool", "cream", "NULL", "cv", "cf", "cs", "cw"),
    *[("separator", f"cheese_{x}", "skim", "NULL", f"vo{x}", f"fa{x}", f"sn{x}", f"wa{x}")
      for x in "ab"],
    *[(f"cheese_{x}", "market", "cheese", f"cheese_{x}", f"chv{x}", f"chf{x}", f"chs{x}", f"chw{x}")
      for x in "ab"],
    *[(f"cheese_{x}", "market", "whey", "'whey'", f"whf{x} + whs{x} + whw{x}", f"whf{x}",
       f"whs{x}", f"whw{x}") for x in "ab"],
    *[(f"cheese_{x}", "pool", "excess_cream", "NULL", f"ex{x}", f"ex{x}", "0e0", "0e0")
      for x in "ab"],
    *[("pool", f"butter_{x}", "cream", "NULL", f"pv{x}", f"pf{x}", f"ps{x}", f"pw{x}") for x in "ab"],
    *[(f"butter_{x}", "market", "butter", "'butter'", f"bv{x}", f"bf{x}", f"bs{x}", f"bw{x}")
      for x in "ab"],
    *[(f"butter_{x}", "market", "powder", f"powder_{x}", f"dv{x}", f"df{x}", f"ds{x}", f"dw{x}")
      for x in "ab"],
]


def moves(keys: str, table: str = "bb3") -> str:
    """Long movements from the wide rows."""
    return "moves AS (" + " UNION ALL ".join(
        f"SELECT {keys}, '{a}' AS from_node, '{b}' AS to_node, '{k}' AS kind, "
        f"CAST({p} AS VARCHAR) AS product, {v} AS volume, {f} AS fat, {n} AS snf, {w} AS water "
        f"FROM {table}" for a, b, k, p, v, f, n, w in _EDGES) + ")"


LEDGER = f"{LOTS}, {plant('lots')}, {moves('site')}"

SUPPLY = f"""supply AS (SELECT event_id, ts, user_id % 10 AS site,
 {PRODUCTS!r}[1 + user_id % 9] AS product, value AS volume,
 CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS tick FROM events)"""


def dense(keys: str) -> str:
    on = " AND ".join(f"k.{c.strip()} = v.{c.strip()}" for c in keys.split(","))
    listed = ", ".join(f"k.{c.strip()}" for c in keys.split(","))
    return f"""{SUPPLY}, {MARKET}, filled AS (SELECT {listed}, m.ord AS product_ord, m.product,
 {s('v.volume')} AS volume FROM (SELECT DISTINCT {keys} FROM supply) k CROSS JOIN market m
 LEFT JOIN supply v ON {on} AND v.product = m.product GROUP BY {listed}, m.ord, m.product)"""


def quoted(keys: str) -> str:
    return f"""{dense(keys)}, quoted AS (SELECT f.*, CASE WHEN f.volume <= 0 THEN base
 ELSE base * pow(demand / f.volume, elast) END AS price FROM filled f JOIN market USING (product)),
quotes AS (SELECT *, volume * price AS revenue FROM quoted)"""


DAILY = quoted("site, tick")


def audit(inner: str, keys: str, components: list[str]) -> str:
    """``inner`` has in_<c> and out_<c> per key."""
    rows = " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS component, in_{c} AS total_in, out_{c} AS total_out FROM sided"
        for c in components)
    pct = "CASE WHEN total_in > 0 THEN abs(total_in - total_out) / total_in * 100e0 ELSE 0e0 END"
    return f"""{inner}, audited AS ({rows})
SELECT {keys}, component, total_in, total_out, {r('total_in - total_out')} AS residual,
 {r(pct)} AS err_pct, {pct} < 0.1e0 AS ok FROM audited"""


COMPONENTS = ["fat", "snf", "water"]

_PLANT_SIDES = "sided AS (SELECT site, " + ", ".join(
    [f"{s(c, 'kind = ' + repr('milk'))} AS in_{c}" for c in COMPONENTS]
    + [f"{s(c, 'to_node = ' + repr('market'))} AS out_{c}" for c in COMPONENTS]
) + " FROM moves GROUP BY site)"

_NODES = "('separator', 'cheese_a', 'cheese_b', 'pool', 'butter_a', 'butter_b')"
_NODE_SIDES = ("arrivals AS (SELECT site, to_node AS node, true AS arrives, fat, snf, water FROM moves "
               "UNION ALL SELECT site, from_node, false, fat, snf, water FROM moves), "
               "sided AS (SELECT site, node, " + ", ".join(
                   [f"{s(c, 'arrives')} AS in_{c}" for c in COMPONENTS]
                   + [f"{s(c, 'NOT arrives')} AS out_{c}" for c in COMPONENTS])
               + f" FROM arrivals WHERE node IN {_NODES} GROUP BY site, node)")

_ORDER_SIDES = f"""sided AS (SELECT coalesce(o.k, l.k) AS order_key, coalesce(o.amount, 0e0) AS in_amount,
 coalesce(l.amount, 0e0) AS out_amount
 FROM (SELECT o_orderkey AS k, {s('o_totalprice')} AS amount FROM orders GROUP BY 1) o
 FULL JOIN (SELECT l_orderkey AS k, {s('l_extendedprice')} AS amount FROM lineitem GROUP BY 1) l
 ON o.k = l.k)"""

_MOVES = f"""SELECT site, product, tick, {r('price')} AS price, {r('price - prev')} AS delta,
 CASE WHEN price - prev > 0.001e0 THEN 'up' WHEN price - prev < -0.001e0 THEN 'down' ELSE 'flat' END
 AS direction FROM (SELECT *, coalesce(lag(price) OVER (PARTITION BY site, product ORDER BY tick),
 price) AS prev FROM quotes)"""

DIRECTION = f"WITH {DAILY} {_MOVES}"

_DOMAINS = [
    ("fat_pct", "range", "fat_pct < 3.2e0 OR fat_pct > 4.8e0"),
    ("snf_pct", "range", "snf_pct < 7.8e0 OR snf_pct > 9.2e0"),
    ("volume", "range", "volume < 200e0 OR volume > 4500e0"),
    ("cream_fat_pct", "range", "cream_fat_pct < 32e0 OR cream_fat_pct > 43e0"),
    ("butter_a_fat_pct", "range", "butter_a_fat_pct < 79e0 OR butter_a_fat_pct > 83e0"),
    ("cheese_a", "member", "cheese_a NOT IN ('cheddar', 'mozzarella', 'swiss')"),
    ("powder_b", "member", "powder_b NOT IN ('nfdm', 'bmp')"),
]

ASOF = """WITH facts AS (SELECT event_id AS fact_id, user_id % 10 AS site, ts, value AS volume
 FROM events WHERE event_type = 'purchase'),
cream AS (SELECT user_id % 10 AS site, ts, CAST(30 + CAST(floor(value) AS BIGINT) % 16 AS DOUBLE) AS v
 FROM events WHERE event_type = 'signup'),
skim AS (SELECT user_id % 10 AS site, ts, CAST(CAST(floor(value) AS BIGINT) % 21 * 5 AS DOUBLE) AS v
 FROM events WHERE event_type = 'click')
SELECT f.fact_id, f.site, f.ts, f.volume, coalesce(c.v, 40e0) AS cream_fat_pct,
 coalesce(k.v, 50e0) AS skim_split_pct
FROM facts f ASOF LEFT JOIN cream c ON f.site = c.site AND f.ts >= c.ts
 ASOF LEFT JOIN skim k ON f.site = k.site AND f.ts >= k.ts"""

# The stress scenarios; NULL leaves the lot's own setting.
SCENARIOS = """scen(scenario_id, scenario, v, f, n, c, ss, cs, bf, pw, ca, cb) AS (VALUES
 (0, 'baseline', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
 (1, 'lean small herd', 100e0, 3e0, 7.5e0, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
 (2, 'rich large herd', 5000e0, 5e0, 9.5e0, NULL, NULL, NULL, NULL, NULL, NULL, NULL),
 (3, 'cream at 30', NULL, NULL, NULL, 30e0, NULL, NULL, NULL, NULL, NULL, NULL),
 (4, 'cream at 45', NULL, NULL, NULL, 45e0, NULL, NULL, NULL, NULL, NULL, NULL),
 (5, 'skim all to b', NULL, NULL, NULL, NULL, 0e0, NULL, NULL, NULL, NULL, NULL),
 (6, 'skim all to a', NULL, NULL, NULL, NULL, 100e0, NULL, NULL, NULL, NULL, NULL),
 (7, 'cream all to b', NULL, NULL, NULL, NULL, NULL, 0e0, NULL, NULL, NULL, NULL),
 (8, 'cream all to a', NULL, NULL, NULL, NULL, NULL, 100e0, NULL, NULL, NULL, NULL),
 (9, 'parmesan only', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'parmesan', 'parmesan'),
 (10, 'whole milk powder', NULL, NULL, NULL, NULL, NULL, NULL, 78e0, 'wmp', NULL, NULL))"""
SCENARIO_LOTS = f"""{LOTS}, {SCENARIOS}, configs AS (SELECT site, scenario_id, scenario,
 coalesce(v, volume) AS volume, coalesce(f, fat_pct) AS fat_pct, coalesce(n, snf_pct) AS snf_pct,
 coalesce(c, cream_fat_pct) AS cream_fat_pct, coalesce(ss, skim_split_pct) AS skim_split_pct,
 coalesce(cs, cream_split_pct) AS cream_split_pct, coalesce(bf, butter_a_fat_pct) AS butter_a_fat_pct,
 butter_b_fat_pct, coalesce(pw, powder_a) AS powder_a, powder_b, coalesce(ca, cheese_a) AS cheese_a,
 coalesce(cb, cheese_b) AS cheese_b FROM lots CROSS JOIN scen)"""


def evaluated(keys: str) -> str:
    """``results``: one row per key and product, from the wide rows ``bb3``."""
    kj = " AND ".join(f"k.{c.strip()} = v.{c.strip()}" for c in keys.split(","))
    listed = ", ".join(f"k.{c.strip()}" for c in keys.split(","))
    return f"""{MARKET}, {moves(keys)}, res AS (SELECT {keys}, """ + ", ".join(
        f"{s(c, 'kind = ' + repr('milk'))} - {s(c, 'to_node = ' + repr('market'))} AS residual_{c}"
        for c in COMPONENTS) + f""" FROM moves GROUP BY {keys}),
made AS (SELECT {keys}, product, {s('volume')} AS volume FROM moves WHERE product IS NOT NULL
 GROUP BY {keys}, product),
results AS (SELECT *, volume * price AS revenue FROM (SELECT {listed}, k.residual_fat, k.residual_snf,
 k.residual_water, m.ord AS product_ord, m.product, coalesce(v.volume, 0e0) AS volume,
 CASE WHEN coalesce(v.volume, 0e0) <= 0 THEN base ELSE base * pow(demand / v.volume, elast) END AS price
 FROM res k CROSS JOIN market m LEFT JOIN made v ON {kj} AND v.product = m.product))"""


SWEEP = f"{SCENARIO_LOTS}, {plant('configs')}, {evaluated('site, scenario_id')}"

_CLOSED = """closed AS (SELECT site, product, tick, volume FROM (SELECT user_id % 10 AS site, {p}[1 + user_id % 9]
 AS product, CAST(date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS BIGINT) AS tick,
 {v} AS volume FROM events GROUP BY 1, 2, 3)
 WHERE TIMESTAMP '1970-01-01' + to_hours(tick + 1)
 <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events))""".format(
    p=repr(PRODUCTS), v=s("value"))
FEED = f"""{MARKET}, {_CLOSED}, quoted AS (SELECT c.*, CASE WHEN volume <= 0 THEN base
 ELSE base * pow(demand / volume, elast) END AS price FROM closed c JOIN market USING (product)),
quotes AS (SELECT *, volume * price AS revenue FROM quoted)"""

_SITE_MASSES = f"sites AS (SELECT site, {sums()} FROM milk GROUP BY site)"
_GRID = f"""{MILK}, {_SITE_MASSES},
configs AS (SELECT site, g AS grid_id, {r('volume')} AS volume, {r('fat / volume * 100e0')} AS fat_pct,
 {r('snf / volume * 100e0')} AS snf_pct, [30e0, 35e0, 40e0, 45e0][1 + g % 4] AS cream_fat_pct,
 [0e0, 30e0, 60e0, 100e0][1 + g // 4 % 4] AS skim_split_pct, {CHEESES}[1 + g // 16 % 4] AS cheese_a,
 ['mozzarella', 'swiss'][1 + g // 64] AS cheese_b, 50e0 AS cream_split_pct, 82e0 AS butter_a_fat_pct,
 80e0 AS butter_b_fat_pct, 'nfdm' AS powder_a, 'bmp' AS powder_b
 FROM sites CROSS JOIN (SELECT unnest(generate_series(0, 127)) AS g))"""

_RULES = f"""{MILK}, {_SITE_MASSES},
configs AS (SELECT site, n_nationkey AS scenario_id, {r('volume')} AS volume,
 {r('fat / volume * 100e0')} AS fat_pct, {r('snf / volume * 100e0')} AS snf_pct,
 30e0 + n_nationkey % 16 AS cream_fat_pct,
 CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 4e0 ELSE 50e0 END AS skim_split_pct,
 'cheddar' AS cheese_a, 'mozzarella' AS cheese_b, 50e0 AS cream_split_pct, 82e0 AS butter_a_fat_pct,
 80e0 AS butter_b_fat_pct, 'nfdm' AS powder_a, 'bmp' AS powder_b FROM sites CROSS JOIN nation)"""

TREND = f"""WITH {DAILY}, micro AS (SELECT *, {u('price')} AS p FROM quotes)
SELECT site, product, tick, {r('CAST(sum(p) OVER w AS DOUBLE) / 1e6 / count(p) OVER w')} AS mean_price,
 {r('min(price) OVER w')} AS min_price, {r('max(price) OVER w')} AS max_price FROM micro
 WINDOW w AS (PARTITION BY site, product ORDER BY tick ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""

_CHANGED = f"""{LOTS}, changed AS (SELECT * REPLACE (CASE WHEN order_key % 10 = 2 THEN volume * 0.5e0 ELSE volume END AS volume)
 FROM lots WHERE order_key % 10 <> 1)"""

#: Least squares of y over x per key: ``logs`` has them, NULL where a row is not used.
_FIT = """fits AS (SELECT {keys}, count(x) AS n, CAST(count(*) - count(x) AS BIGINT) AS left_out, max(goal) AS goal,
 max(x) - min(x) > 1e-9 AS varied, -regr_slope(y, x) AS slope, regr_intercept(y, x) AS cut, regr_r2(y, x) AS fit
 FROM logs GROUP BY {keys}),
told AS (SELECT *, CASE WHEN n >= 2 AND varied THEN slope END AS elasticity,
 CASE WHEN n >= 2 AND varied THEN goal * exp(cut / slope) END AS fitted, CASE WHEN n >= 2 AND varied THEN fit END AS r2,
 CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'point' WHEN NOT varied THEN 'constant' ELSE 'fitted' END AS outcome FROM fits)"""

ORACLES: dict[str, str] = {
    "cream_and_skim_by_site": f"""WITH {SEPARATED} SELECT site, kind, {sums()},
 count(*) FILTER (WHERE NOT abs(fat + snf + water - volume) < 0.001e0) AS n_open
 FROM split GROUP BY site, kind""",
    "lot_masses_by_site": f"WITH {MILK} SELECT site, {sums()} FROM milk GROUP BY site",
    "closure_by_site": f"""WITH {MILK}, gaps AS (SELECT site,
 abs(fat + snf + volume * 0.87e0 - volume) AS gap FROM milk)
SELECT site, count(*) AS n_flows, count(*) FILTER (WHERE NOT gap < 0.001e0) AS n_open,
 {r('max(gap)')} AS max_gap FROM gaps GROUP BY site""",
    "composition_by_site": f"""WITH {MILK}, {_SITE_MASSES} SELECT site, """ + ", ".join(
        f"CASE WHEN volume = 0 THEN 0e0 ELSE {r(f'{c} / volume * 100e0')} END AS {c}_pct"
        for c in COMPONENTS) + " FROM sites",
    "domain_violations": f"WITH {LOTS}, bad AS (" + " UNION ALL ".join(
        f"SELECT site, '{c}' AS parameter, '{kind}' AS rule FROM lots WHERE {cond}"
        for c, kind, cond in _DOMAINS)
    + ") SELECT site, parameter, rule, count(*) AS n_violations FROM bad GROUP BY ALL",
    "yield_split_by_recipe": f"""WITH {CURDLED} SELECT cheese_type, kind, {sums()} FROM curd
 GROUP BY cheese_type, kind""",
    "churn_split_by_powder": f"""WITH {SEPARATED},
c1 AS (SELECT *, fat * 0.99e0 AS bf, fat * 0.99e0 / (butter_fat_pct / 100e0) AS bv
 FROM split WHERE kind = 'cream'),
c2 AS (SELECT *, bv * 0.015e0 AS bs, bv - bf - bv * 0.015e0 AS bw, CASE WHEN powder_type = 'wmp'
 THEN (0.26e0 * (volume - bv) - (fat - bf)) / (1e0 - 0.26e0) ELSE 0e0 END AS x FROM c1),
outs AS (SELECT powder_type, 'butter' AS product, bv - x AS volume, bf - x AS fat, bs AS snf,
  bw AS water FROM c2
 UNION ALL SELECT powder_type, powder_type, (volume - bv) + x, (fat - bf) + x, snf - bs, water - bw
  FROM c2)
SELECT powder_type, product, {sums()} FROM outs GROUP BY powder_type, product""",
    "allocate_flows": f"""WITH {SEPARATED}, routes(kind, to_node, share) AS (VALUES
 ('skim', 'cheese_a', 0.5e0), ('skim', 'cheese_b', 0.3e0),
 ('skim', 'cheese_c', 1e0 - (0.5e0 + 0.3e0)), ('cream', 'butter_a', 0.6e0),
 ('cream', 'butter_b', 1e0 - 0.6e0)),
sent AS (SELECT site, to_node, volume * share AS volume, fat * share AS fat, snf * share AS snf,
 water * share AS water FROM split JOIN routes USING (kind))
SELECT site, to_node, {sums()} FROM sent GROUP BY site, to_node""",
    "recipe_rejects": f"""WITH {LOTS} SELECT site, cheese_type, count(*) AS n_lots,
 {s('volume')} AS volume FROM lots WHERE cheese_type NOT IN ('cheddar', 'mozzarella', 'swiss')
 GROUP BY site, cheese_type""",
    "pooled_cream": f"""WITH {SEPARATED}, {CURDLED.replace(MILK + ', ', '')}, both_creams AS (
 SELECT site, volume, fat, snf, water FROM split WHERE kind = 'cream'
 UNION ALL SELECT site, volume, fat, snf, water FROM curd WHERE kind = 'excess_cream')
SELECT site, {sums()} FROM both_creams GROUP BY site""",
    "milk_union": f"""WITH {SEPARATED}, {RECIPES}, surplus AS (
 SELECT site, fat - least(snf * 0.296e0 / cf_ratio, fat) AS ex FROM milk JOIN recipes ON cheese = cheese_a
 UNION ALL SELECT site, fat - least(snf * 0.296e0 / cf_ratio, fat) FROM milk JOIN recipes ON cheese = cheese_b),
united AS (SELECT site, volume, fat, snf, water FROM split WHERE kind = 'cream'
 UNION ALL SELECT site, ex, ex, 0e0, 0e0 FROM surplus WHERE ex > 0.001e0
 UNION ALL SELECT s_suppkey, 0e0, 0e0, 0e0, 0e0 FROM supplier)
SELECT site, {sums()} FROM united GROUP BY site""",
    "lot_volume_decimal": f"""WITH {MILK} SELECT site, """ + ", ".join(
        f"{r(f'CAST(SUM(CAST({c} AS DECIMAL(38, 15))) AS DOUBLE)', 2)} AS {c}"
        for c in ("volume", "fat", "snf")) + " FROM milk GROUP BY site",
    "lot_rejects": f"""WITH {LOTS}, judged AS (SELECT site, CASE
 WHEN fat_pct < 3.2e0 THEN 'fat_pct is too low' WHEN fat_pct > 4.8e0 THEN 'fat_pct is too high'
 WHEN snf_pct < 7.8e0 THEN 'snf_pct is too low' WHEN snf_pct > 9.2e0 THEN 'snf_pct is too high'
 WHEN volume < 200e0 THEN 'volume is too low' WHEN volume > 4500e0 THEN 'volume is too high'
 WHEN skim_split_pct < 5e0 THEN 'skim_split_pct is too low'
 WHEN skim_split_pct > 95e0 THEN 'skim_split_pct is too high' END AS reject_reason FROM lots)
SELECT site, reject_reason, count(*) AS n_lots FROM judged WHERE reject_reason IS NOT NULL
 GROUP BY site, reject_reason""",
    "powder_rejects": f"""WITH {LOTS} SELECT site, powder_type, count(*) AS n_lots,
 {s('volume')} AS volume FROM lots WHERE powder_type = 'wmp' GROUP BY site, powder_type""",
    "plant_rejects": f"""WITH {LOTS} SELECT site, count(*) AS n_lots, {s('volume')} AS volume FROM lots
 WHERE 'parmesan' IN (cheese_a, cheese_b) OR 'wmp' IN (powder_a, powder_b) GROUP BY site""",
    "unallocated_flows": f"""WITH {SEPARATED} SELECT site, kind, {sums()} FROM split
 WHERE kind = 'cream' GROUP BY site, kind""",
    "masses_by_region": f"""WITH {MILK} SELECT r_name AS region, {sums()} FROM milk
 LEFT JOIN supplier ON s_suppkey = site LEFT JOIN nation ON n_nationkey = s_nationkey
 LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""",
    "lot_ledger_rollup": f"""WITH {LEDGER} SELECT site, product, {s('volume')} AS volume FROM moves
 WHERE product IS NOT NULL GROUP BY site, product""",
    "ledger_edges": f"""WITH {LEDGER} SELECT from_node, to_node, kind, {sums()} FROM moves
 GROUP BY from_node, to_node, kind""",
    "plant_mass_balance": audit(f"WITH {LEDGER}, {_PLANT_SIDES}", "site", COMPONENTS),
    "movement_balance": audit(f"WITH {LEDGER}, {_PLANT_SIDES}", "site", COMPONENTS),
    "node_reconciliation": audit(f"WITH {LEDGER}, {_NODE_SIDES}", "site, node", COMPONENTS),
    "order_line_reconciliation": audit(f"WITH {_ORDER_SIDES}", "order_key", ["amount"]),
    "supply_wide": f"WITH {SUPPLY} SELECT site, tick, " + ", ".join(
        f"{s('volume', f'product = {p!r}')} AS {p}" for p in PRODUCTS)
    + " FROM supply GROUP BY site, tick",
    "supply_long": f"WITH {dense('site, tick')} SELECT * FROM filled",
    "elastic_prices": f"""WITH {DAILY} SELECT site, tick, product_ord, product, volume,
 {r('price')} AS price, {r('revenue', 4)} AS revenue FROM quotes""",
    "price_sensitivity": f"""WITH {dense('site')}, tried AS (SELECT f.*, e AS elasticity,
 CASE WHEN volume <= 0 THEN base ELSE base * pow(demand / volume, e) END AS price
 FROM filled f JOIN market USING (product)
 CROSS JOIN (VALUES (0.1e0), (0.2e0), (0.3e0), (0.5e0), (1e0)) t(e))
SELECT site, product_ord, product, volume, elasticity, {r('price')} AS price,
 {r('volume * price', 4)} AS revenue FROM tried""",
    "revenue_by_day": f"""WITH {DAILY} SELECT site, tick, {r(s('revenue'), 4)} AS revenue FROM quotes
 GROUP BY site, tick""",
    "revenue_rollup": f"""WITH {DAILY} SELECT site, product,
 CAST(GROUPING(site, product) AS INTEGER) AS level, {r(s('revenue'), 4)} AS revenue FROM quotes
 WHERE volume > 0 GROUP BY GROUPING SETS ((site, product), (site), ())""",
    "revenue_top3": f"""WITH {DAILY} SELECT site, tick, product_ord, product, volume,
 {r('price')} AS price, {r('revenue', 4)} AS revenue,
 CAST(row_number() OVER (PARTITION BY site, tick ORDER BY quotes.revenue DESC, product_ord) AS INTEGER)
 AS rank FROM quotes WHERE volume > 0 QUALIFY rank <= 3""",
    "revenue_sorted": f"""WITH {DAILY} SELECT site, tick, product, {r('revenue', 4)} AS revenue
 FROM quotes WHERE volume > 0 ORDER BY quotes.revenue DESC, product_ord, site, tick""",
    "revenue_top100": f"""WITH {DAILY} SELECT site, tick, product, {r('revenue', 4)} AS revenue
 FROM quotes WHERE volume > 0 ORDER BY quotes.revenue DESC, product_ord, site, tick LIMIT 100""",
    "product_rejects": f"""WITH {SUPPLY} SELECT site, product, count(*) AS n_events,
 {s('volume')} AS volume FROM supply WHERE product = 'whey' GROUP BY site, product""",
    "price_direction": DIRECTION,
    "price_direction_segmented": DIRECTION,
    "price_trend": TREND,
    "price_trend_segmented": TREND,
    "bar_ratio": f"""WITH {dense('site, tick')} SELECT *, {r('''volume / greatest(max(volume)
 OVER (PARTITION BY site, tick), 1e0) * 100e0''')} AS bar_pct FROM filled WHERE volume > 0""",
    "market_override": f"""WITH {dense('site, tick')}, goal AS (SELECT site, product,
 {s('volume')} / count(*) AS own FROM filled GROUP BY site, product),
p AS (SELECT f.*, own, CASE WHEN volume <= 0 THEN base ELSE base * pow(own / volume, elast) END AS price
 FROM filled f JOIN market USING (product) JOIN goal USING (site, product))
SELECT site, tick, product, volume, {r('own')} AS demand, {r('price')} AS price,
 {r('volume * price', 4)} AS revenue FROM p""",
    "asof_params": ASOF,
    "asof_params_small_log": ASOF,
    "params_stream": ASOF,
    "scenario_override": f"""WITH {SCENARIO_LOTS} SELECT scenario_id, scenario, cheese_a, powder_a,
 count(*) AS n_lots, """ + ", ".join(f"{s(c)} AS {c}" for c in (
        "volume", "fat_pct", "snf_pct", "cream_fat_pct", "skim_split_pct", "cream_split_pct",
        "butter_a_fat_pct")) + " FROM configs GROUP BY ALL",
    "scenario_sweep": f"""WITH {SWEEP} SELECT site, scenario_id, product_ord, product, volume,
 {r('price')} AS price, {r('revenue', 4)} AS revenue, {r('residual_fat')} AS residual_fat,
 {r('residual_snf')} AS residual_snf, {r('residual_water')} AS residual_water FROM results""",
    "scenario_delta": f"""WITH {SWEEP}, paired AS (SELECT *, """ + ", ".join(
        f"max(CASE WHEN scenario_id = 0 THEN {c} END) OVER (PARTITION BY site, product) AS base_{c}"
        for c in ("volume", "price", "revenue")) + f""" FROM results)
SELECT site, scenario_id, product, {r('volume - base_volume')} AS delta_volume,
 {r('price - base_price')} AS delta_price, {r('revenue - base_revenue', 4)} AS delta_revenue
 FROM paired""",
    "best_scenario": f"""WITH {SWEEP}, totals AS (SELECT site, scenario_id, {s('revenue')} AS revenue
 FROM results GROUP BY site, scenario_id)
SELECT site, scenario_id, {r('revenue', 4)} AS revenue FROM totals
QUALIFY row_number() OVER (PARTITION BY site ORDER BY totals.revenue DESC, scenario_id) = 1""",
    "scenario_invariants": f"""WITH {SCENARIO_LOTS}, {plant('configs')},
sold AS (SELECT scenario_id, unnest([bva, bvb, dva, dvb, chva, chvb, whfa + whsa + whwa,
 whfb + whsb + whwb]) AS v FROM bb3)
SELECT scenario_id, count(*) AS n_rows, count(*) FILTER (WHERE isnan(v)) AS n_nan,
 count(*) FILTER (WHERE v < -0.5e-6) AS n_negative, {r('min(v)')} AS min_value,
 {r('max(v)')} AS max_value,
 count(*) FILTER (WHERE isnan(v) OR v < -0.5e-6) = 0 AS sound FROM sold GROUP BY scenario_id""",
    "result_invariants": f"""WITH {SWEEP} SELECT scenario_id, count(*) AS n_rows,
 count(*) FILTER (WHERE isnan(volume)) AS n_nan, count(*) FILTER (WHERE volume < 0) AS n_negative,
 min(volume) AS min_value, max(volume) AS max_value, bool_and(volume >= 0) AS sound
 FROM results GROUP BY scenario_id""",
    "scenario_table": f"""WITH {_RULES}, {plant('configs')}, {evaluated('site, scenario_id')}
SELECT site, scenario_id, {r(s('revenue'), 4)} AS revenue FROM results GROUP BY site, scenario_id""",
    "grid_sweep": f"""WITH {_GRID}, {plant('configs')}, {evaluated('site, grid_id')}
SELECT site, grid_id, {r(s('revenue'), 4)} AS revenue FROM results GROUP BY site, grid_id""",
    "price_feed_stream": f"""WITH {FEED} SELECT tick, site, product, volume, {r('price')} AS price,
 {r('revenue', 4)} AS revenue FROM quotes""",
    "price_direction_stream": f"WITH {FEED} {_MOVES}",
    "price_feed_amended": f"""WITH {FEED.replace(_CLOSED, _CLOSED.rsplit(" WHERE ", 1)[0] + ")")} SELECT tick, site,
 product, volume, {r('price')} AS price, {r('revenue', 4)} AS revenue FROM quotes""",
    "params_keyed_stream": f"""SELECT * FROM ({ASOF}) WHERE ts <= (SELECT date_trunc('millisecond', max(ts))
 - INTERVAL 2 HOUR FROM events WHERE event_type IN ('purchase', 'signup', 'click'))""",
    "maintained_production": f"""WITH {_CHANGED}, {plant('changed')}, {moves('site')}, {MARKET},
made AS (SELECT site, product, {s('volume')} AS volume FROM moves WHERE product IS NOT NULL GROUP BY site, product)
SELECT k.site, m.ord AS product_ord, m.product, coalesce(v.volume, 0e0) AS volume
 FROM (SELECT DISTINCT site FROM changed) k CROSS JOIN market m LEFT JOIN made v ON v.site = k.site AND v.product = m.product""",
    "maintained_scenarios": f"""WITH {_CHANGED}, {SCENARIO_LOTS.replace(LOTS + ", ", "").replace("FROM lots CROSS", "FROM changed CROSS")},
 {plant('configs')}, {evaluated('site, scenario_id')} SELECT site, scenario_id, product_ord, product, volume,
 {r('price')} AS price, {r('revenue', 4)} AS revenue, {r('residual_fat')} AS residual_fat,
 {r('residual_snf')} AS residual_snf, {r('residual_water')} AS residual_water FROM results""",
    "network_throughput": f"""WITH RECURSIVE {MILK}, sites AS (SELECT cheese_type, 'site-' || site AS node, {sums()} FROM milk GROUP BY cheese_type, site),
routes(from_node, to_node, share) AS (
 SELECT 'site-' || s_suppkey, 'nation-' || s_nationkey, 0.7e0 FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION ALL SELECT 'site-' || s_suppkey, 'region-' || n_regionkey, 1e0 - 0.7e0 FROM supplier JOIN nation ON n_nationkey = s_nationkey
 UNION ALL SELECT 'nation-' || n.n_nationkey, 'nation-' || m.n_nationkey, 0.25e0 FROM nation n JOIN nation m ON m.n_nationkey = n.n_nationkey + 9
 UNION ALL SELECT 'nation-' || n.n_nationkey, 'region-' || n.n_regionkey, CASE WHEN m.n_nationkey IS NULL THEN 1e0 ELSE 1e0 - 0.25e0 END
  FROM nation n LEFT JOIN nation m ON m.n_nationkey = n.n_nationkey + 9
 UNION ALL SELECT 'region-' || r_regionkey, 'market', 0.9e0 FROM region
 UNION ALL SELECT 'region-' || r_regionkey, 'reserve', 1e0 - 0.9e0 FROM region),
wave AS (SELECT 0 AS hop, * FROM sites
 UNION ALL SELECT hop + 1, cheese_type, to_node, {", ".join(f"{s(f'{m} * share')} AS {m}" for m in ("volume", "fat", "snf", "water"))}
 FROM wave JOIN routes ON from_node = node GROUP BY hop, cheese_type, to_node)
SELECT cheese_type, node, {sums()} FROM wave GROUP BY cheese_type, node""",
    "price_announced": f"""WITH RECURSIVE {quoted('site, tick').replace("'day', DATE '1970-01-01', CAST(ts AS DATE)", "'hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)")},
told AS (SELECT site, product, tick, {r('price')} AS price, row_number() OVER (PARTITION BY site, product ORDER BY tick) AS k FROM quotes),
moves AS (SELECT site, product, tick, price, k, price AS announced, 0e0 AS delta, 'flat' AS direction FROM told WHERE k = 1
 UNION ALL SELECT t.site, t.product, t.tick, t.price, t.k, CASE WHEN abs(t.price - m.announced) > 0.05e0 THEN t.price ELSE m.announced END,
  t.price - m.announced, CASE WHEN t.price - m.announced > 0.05e0 THEN 'up' WHEN t.price - m.announced < -0.05e0 THEN 'down' ELSE 'flat' END
 FROM moves m JOIN told t ON t.site = m.site AND t.product = m.product AND t.k = m.k + 1)
SELECT site, product, tick, price, announced, {r('delta')} AS delta, direction FROM moves""",
    "fitted_market": f"""WITH {DAILY}, logs AS (SELECT site, product, demand AS goal, base, volume > 0 AS use,
 CASE WHEN volume > 0 THEN ln(volume / demand) END AS x, CASE WHEN volume > 0 THEN ln(price / base) END AS y
 FROM quotes JOIN market USING (product)), {_FIT.format(keys='site, product')}
SELECT site, product, n, left_out, {r('elasticity')} AS elasticity, {r('fitted')} AS demand, {r('r2')} AS r2, outcome FROM told""",
    "fitted_order_prices": f"""WITH logs AS (SELECT l_suppkey AS site, 1e0 AS goal, l_quantity > 0 AND l_extendedprice > 0 AS use,
 CASE WHEN use THEN ln(l_quantity) END AS x, CASE WHEN use THEN ln(l_extendedprice / l_quantity) END AS y
 FROM lineitem), {_FIT.format(keys='site')}
SELECT site, n, left_out, {r('elasticity')} AS elasticity, {r('r2')} AS r2, outcome FROM told""",
    "scenario_frontier": f"""WITH {_GRID}, {plant('configs')}, {evaluated('site, grid_id')},
tried AS (SELECT site, grid_id, {r(s('revenue'), 4)} AS revenue, {r(s('volume'))} AS made,
 {r('max(abs(residual_fat) + abs(residual_snf) + abs(residual_water))')} AS left_over FROM results GROUP BY site, grid_id)
SELECT * FROM tried t WHERE NOT EXISTS (SELECT 1 FROM tried o WHERE o.site = t.site AND o.revenue >= t.revenue
 AND o.made <= t.made AND o.left_over <= t.left_over
 AND (o.revenue > t.revenue OR o.made < t.made OR o.left_over < t.left_over))""",
    "price_range_trend": f"""WITH {quoted('site, tick').replace("'day', DATE '1970-01-01', CAST(ts AS DATE)", "'hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)")},
told AS (SELECT site, product, tick, {r('price')} AS price FROM quotes)
SELECT *, count(*) OVER w AS n_price, {r(f"CAST(sum({u('price')}) OVER w AS DOUBLE) / 1e6 / count(*) OVER w")} AS mean_price,
 min(price) OVER w AS min_price, max(price) OVER w AS max_price FROM told
 WINDOW w AS (PARTITION BY site, product ORDER BY tick RANGE BETWEEN 168 PRECEDING AND CURRENT ROW)""",
    "supply_range_trend": f"""WITH told AS (SELECT event_id, user_id % 10 AS site,
 date_diff('minute', TIMESTAMP '1970-01-01', date_trunc('minute', ts)) AS tick, value AS volume FROM events)
SELECT *, count(*) OVER w AS n_volume, {r(f"CAST(sum({u('volume')}) OVER w AS DOUBLE) / 1e6 / count(*) OVER w")} AS mean_volume,
 min(volume) OVER w AS min_volume, max(volume) OVER w AS max_volume FROM told
 WINDOW w AS (PARTITION BY site ORDER BY tick RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW)""",
    "watched_supply": f"""WITH {SUPPLY}, made AS (SELECT site, product, tick, {s('volume')} AS volume FROM supply GROUP BY site, product, tick),
told AS (SELECT count(*) AS n, count(*) FILTER (WHERE isnan(volume)) AS bad, count(*) FILTER (WHERE volume IS NULL) AS gone,
 min(volume) AS least, max(volume) AS most FROM made),
judged(metric, value, low, high) AS (SELECT 'n_rows', CAST(n AS DOUBLE), 1e0, NULL FROM told UNION ALL SELECT 'n_nan', bad, NULL, 0e0 FROM told
 UNION ALL SELECT 'n_missing', gone, NULL, 0e0 FROM told UNION ALL SELECT 'least', least, 0e0, 400e0 FROM told
 UNION ALL SELECT 'most', most, 0e0, 400e0 FROM told)
SELECT site, product, tick, volume, NULL AS metric, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high,
 CAST(NULL AS BOOLEAN) AS ok FROM made UNION ALL
SELECT NULL, NULL, NULL, NULL, metric, value, low, high, coalesce(value >= low, true) AND coalesce(value <= high, true) FROM judged""",
}
