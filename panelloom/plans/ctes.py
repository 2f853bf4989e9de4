"""Common table expressions of the oracle SQL (DuckDB), built up by name."""

_PANEL = """{ev} AS (SELECT {node} AS node, date_trunc('{step}', CAST({ts} AS TIMESTAMP)) AS ts, round(avg(CAST({value} AS DOUBLE)) * 64) / 64 AS value FROM {table} GROUP BY 1, 2),
{ev}b AS (SELECT min(ts) AS lo, max(ts) AS hi FROM {ev}),
{ev}g AS (SELECT node, unnest(generate_series(lo, hi, INTERVAL 1 {step})) AS ts, lo FROM (SELECT DISTINCT node FROM {ev}), {ev}b),
{name} AS (SELECT g.node, g.ts, CAST(date_diff('{step}', g.lo, g.ts) AS BIGINT) AS t, e.value, e.value IS NOT NULL AS observed
  FROM {ev}g g LEFT JOIN {ev} e ON e.node = g.node AND e.ts = g.ts)"""

CTES = {
    "p0": _PANEL.format(ev="pe", node="user_id % 36", step="hour", ts="ts", value="value", table="events", name="p0"),
    "panel": "panel AS (SELECT *, observed AND (t * 31 + node * 17) % 10 = 0 AS eval, observed AND NOT (t * 31 + node * 17) % 10 = 0 AS train FROM p0)",
    "p5": _PANEL.format(ev="te", node="event_type", step="hour", ts="ts", value="value", table="events", name="p5"),
    "daily": _PANEL.format(ev="de", node="o_orderpriority", step="day", ts="o_orderdate", value="o_totalprice", table="orders", name="daily"),
    "st": "st AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(n_nationkey * 37 % 121 - 60 AS DOUBLE) AS latitude, CAST(n_nationkey * 53 % 360 - 180 AS DOUBLE) AS longitude FROM nation)",
    "geo": """geo1 AS (SELECT a.node AS src, b.node AS dst, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(b.latitude) - radians(a.latitude)) / 2), 2)
  + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin((radians(b.longitude) - radians(a.longitude)) / 2), 2)))) AS d FROM st a, st b WHERE a.node < b.node),
geo AS (SELECT src, dst, d FROM geo1 UNION ALL SELECT dst, src, d FROM geo1)""",
    "dist": """dist1 AS (SELECT a.node AS src, b.node AS dst, sqrt(sum((a.value - b.value) * (a.value - b.value)) / count(*)) AS d
  FROM panel a JOIN panel b ON a.t = b.t AND a.node < b.node WHERE a.train AND b.train GROUP BY 1, 2),
dist AS (SELECT src, dst, d FROM dist1 UNION ALL SELECT dst, src, d FROM dist1)""",
    "aff": """th AS (SELECT greatest(stddev_samp(d), 1e-6) AS theta FROM dist WHERE d > 0),
aff AS (SELECT src, dst, exp(-0.1 * pow(d / theta, 2)) AS weight FROM dist, th WHERE d > 0)""",
    "graph": """rk AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS r FROM (SELECT src, dst, round(weight, 9) AS weight FROM aff)),
graph AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM rk WHERE r <= 3 UNION ALL SELECT dst, src, weight FROM rk WHERE r <= 3) GROUP BY 1, 2)""",
    "und": "und AS (SELECT src, dst, weight FROM graph WHERE src < dst)",
    "deg": "deg AS (SELECT src AS node, count(*) AS degree, sum(weight) AS strength FROM graph GROUP BY 1)",
    "vec": "vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "ser": """ff AS (SELECT node, t, last_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f,
  first_value(value IGNORE NULLS) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p5),
ser AS (SELECT node AS series, t, coalesce(f, b) AS x FROM ff)""",
    "smp": """smp AS (SELECT a.t AS sample, a.t AS first_t, a.t + 35 AS last_t, a.ts AS start_ts, b.ts AS end_ts FROM (SELECT DISTINCT t, ts FROM daily) a JOIN (SELECT DISTINCT t, ts FROM daily) b ON b.t = a.t + 35)""",
    "pred": """w5 AS (SELECT DISTINCT t AS sample FROM p5 WHERE t + 35 <= (SELECT max(t) FROM p5)),
pred AS (SELECT sample, node, sample + k AS t, m AS prediction FROM (SELECT w5.sample, p5.node, avg(p5.value) AS m FROM w5 JOIN p5 ON p5.t BETWEEN w5.sample AND w5.sample + 35 GROUP BY 1, 2), (SELECT unnest(range(0, 36)) AS k))""",
    "imp": """nr AS (SELECT p.t, g.dst AS node, sum(g.weight * p.value) / sum(g.weight) AS near FROM graph g JOIN panel p ON p.node = g.src WHERE p.train GROUP BY 1, 2),
mn AS (SELECT node, avg(value) AS mean FROM panel WHERE train GROUP BY 1),
imp AS (SELECT p.*, coalesce(nr.near, mn.mean) AS prediction FROM panel p LEFT JOIN nr ON nr.t = p.t AND nr.node = p.node LEFT JOIN mn ON mn.node = p.node)""",
}

NEEDS = {
    "panel": ["p0"], "geo": ["st"], "dist": ["panel"], "aff": ["dist"], "graph": ["aff"], "und": ["graph"], "deg": ["graph"], "ser": ["p5"], "smp": ["daily"], "pred": ["p5"], "imp": ["graph"],
}


def sql(tables: str, body: str) -> str:
    """`body` under the tables it names (space-separated) and all that those need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in tables.split():
        add(name)
    recursive = "WITH RECURSIVE " if "UNION ALL SELECT t + 1" in body else "WITH "
    head = ",\n".join(CTES[n] for n in order)
    if body.startswith(","):
        return recursive + head + body
    return (recursive + head + "\n" if head else "") + body
