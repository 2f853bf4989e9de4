"""Registry of the library's queries, each over its whole tables, with the DuckDB SQL that must agree.

Floating results are rounded to six digits on both sides, since sums depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.functions import exprs
from panelloom.operators import cells, profile, propagate, scores, spatial, split, temporal, vectors
from panelloom.plans.ctes import sql
from panelloom.session import stored
from panelloom.sources import panels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, tables: str | None = None, body: str = ""):
    """Register a query, with its oracle unless tables is None."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if tables is not None:
            ORACLE[name] = sql(tables, body)
        return f

    return put


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*(r6(c, c, digits) if c in names else F.col(c) for c in df.columns))


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return cells.training(panels.hourly(spark, sf))


def _weights(panel: DataFrame) -> DataFrame:
    """Affinities of the panel's nodes, rounded to nine digits, so that ties fall alike everywhere; distances are computed once."""
    distances = stored(spatial.masked_euclidean(panel), "distances")
    return spatial.gaussian(distances, gamma=0.1, digits=9)


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The similarity graph of the hourly panel, and the panel: both written once, since what builds on them reads them often."""
    p = stored(_panel(spark, sf), "panel")
    return stored(spatial.top_k(_weights(p), 3), "graph"), p


def _graph(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spatial.top_k(_weights(_panel(spark, sf)), 3), "graph")


def _series(spark: SparkSession, sf: str) -> DataFrame:
    p = cells.fill_gaps(panels.by_type(spark, sf))
    return p.select(F.col("node").alias("series"), "t", F.col("value").alias("x"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return split.samples(panels.daily_orders(spark, sf), 36)


# Panels, masks, fills, scaling


@query("panel_hourly", "panel", "SELECT node, t, value, observed, eval FROM panel")
def panel_hourly(spark, sf):
    return panels.hourly(spark, sf).select("node", "t", "value", "observed", "eval")


@query("panel_daily", "daily", "SELECT node, t, value, observed FROM daily")
def panel_daily(spark, sf):
    return panels.load(spark, sf, "daily_orders").select("node", "t", "value", "observed")


@query("observed_mask", "panel", "SELECT node, count(*) FILTER (observed) AS seen, count(*) FILTER (NOT observed) AS missing FROM panel GROUP BY 1")
def observed_mask(spark, sf):
    return panels.hourly(spark, sf).groupBy("node").agg(F.count_if("observed").alias("seen"), F.count_if(~F.col("observed")).alias("missing"))


@query("training_mask", "panel", "SELECT node, t, train, CASE WHEN train THEN value ELSE 0 END AS x FROM panel")
def training_mask(spark, sf):
    return _panel(spark, sf).select("node", "t", "train", "x")


@query("masked_nodes", "panel", "SELECT node, count(*) FILTER (eval OR (node IN (3, 7) AND observed)) AS held_out FROM panel GROUP BY 1")
def masked_nodes(spark, sf):
    return panels.mask_nodes(panels.hourly(spark, sf), [3, 7]).groupBy("node").agg(F.count_if("eval").alias("held_out"))


@query(
    "mask_counts",
    "panel",
    "SELECT count(*) AS total, count(*) FILTER (observed AND eval) AS overlap, count(*) FILTER (observed AND NOT eval) AS only_mask, count(*) FILTER (NOT observed AND eval) AS only_other, "
    "count(*) FILTER (NOT observed AND NOT eval) AS neither, bool_and(observed = eval) AS equal, bool_and(NOT eval OR observed) AS other_in_mask FROM panel",
)
def mask_counts(spark, sf):
    return cells.mask_counts(panels.hourly(spark, sf))


@query("mean_fill", "panel", "SELECT node, t, round(coalesce(value, avg(value) OVER (PARTITION BY node)), 6) AS filled FROM panel")
def mean_fill(spark, sf):
    return cells.mean_fill(panels.hourly(spark, sf)).select("node", "t", r6("filled", "filled"))


_LEVEL = "{b} AS (SELECT node, ts, t, coalesce(v, avg(v) OVER (PARTITION BY node, {keys})) AS v FROM {a})"


@query(
    "fill_hierarchical",
    "p0",
    ", h0 AS (SELECT node, ts, t, value AS v FROM p0), "
    + ", ".join(
        _LEVEL.format(a=f"h{k}", b=f"h{k + 1}", keys=keys)
        for k, keys in enumerate(("year(ts), week(ts), hour(ts)", "year(ts), month(ts), hour(ts)", "month(ts), hour(ts)", "hour(ts)"))
    )
    + " SELECT node, t, round(coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "first_value(v IGNORE NULLS) OVER (PARTITION BY node ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS filled FROM h4",
)
def fill_hierarchical(spark, sf):
    return cells.hierarchical_fill(panels.hourly(spark, sf)).select("node", "t", r6("filled", "filled", 8))


@query("ffill_bfill", "ser", "SELECT series, t, x FROM ser")
def ffill_bfill(spark, sf):
    return _series(spark, sf)


@query(
    "resample",
    "p5",
    "SELECT node, t // 24 AS bucket, avg(value) AS mean, sum(value) AS sum, arg_min(value, t) FILTER (observed) AS nearest, bool_and(observed) AS observed FROM p5 GROUP BY 1, 2",
)
def resample(spark, sf):
    return cells.resample(panels.by_type(spark, sf), 24)


@query("scale_standard", "panel", "SELECT p.node, t, round((value - b) / s, 6) AS scaled FROM panel p JOIN (SELECT node, avg(value) AS b, stddev_pop(value) AS s FROM panel GROUP BY 1) q ON p.node = q.node WHERE observed AND s > 0")
def scale_standard(spark, sf):
    p = panels.hourly(spark, sf)
    return cells.scale(p, cells.standard_scaler(p, ["node"]), ["node"]).filter("scaled IS NOT NULL").select("node", "t", r6("scaled", "scaled"))


@query("scale_minmax", "panel", "SELECT node, t, round((value - b) / s, 9) AS scaled FROM panel, (SELECT min(value) AS b, max(value) - min(value) AS s FROM panel WHERE train) WHERE observed")
def scale_minmax(spark, sf):
    p = _panel(spark, sf)
    return cells.scale(p, cells.minmax_scaler(p, [], F.col("train")), []).filter("observed").select("node", "t", r6("scaled", "scaled", 9))


@query(
    "scaler_parameters",
    "panel",
    "SELECT node, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) - min(value) AS reach, count(value) AS n FROM panel GROUP BY GROUPING SETS ((node), ())",
)
def scaler_parameters(spark, sf):
    p = panels.hourly(spark, sf)
    value = F.col("value")
    return p.rollup("node").agg(r6(F.avg(value), "mean"), r6(F.stddev_pop(value), "std"), F.min(value).alias("low"), (F.max(value) - F.min(value)).alias("reach"), F.count(value).alias("n"))


@query("whiten_random")
def whiten_random(spark, sf):
    return cells.whiten(panels.hourly(spark, sf)).groupBy("node").agg(F.count_if("kept").alias("kept"), F.count_if("eval").alias("held_out"))


# Samples and splits


@query("sliding_samples", "smp", "SELECT sample, first_t, last_t FROM smp")
def sliding_samples(spark, sf):
    return _samples(spark, sf).select("sample", "first_t", "last_t")


@query(
    "month_split",
    "smp",
    "SELECT sample, CASE WHEN month(start_ts) IN (3, 6, 9, 12) AND month(end_ts) IN (3, 6, 9, 12) THEN 'test' WHEN month(start_ts) IN (2, 5, 8, 11) AND month(end_ts) IN (2, 5, 8, 11) THEN 'val' "
    "WHEN month(start_ts) IN (1, 4, 7, 10) AND month(end_ts) IN (1, 4, 7, 10) THEN 'train' END AS phase FROM smp",
)
def month_split(spark, sf):
    return split.month_split(_samples(spark, sf)).select("sample", "phase")


@query("sample_overlap", "smp", "SELECT DISTINCT a.sample FROM smp a JOIN smp b ON b.first_t <= a.last_t AND a.first_t <= b.last_t WHERE a.sample % 2 = 0 AND month(b.start_ts) = 3 AND month(b.end_ts) = 4")
def sample_overlap(spark, sf):
    s = _samples(spark, sf)
    return split.overlapping(s.filter("sample % 2 = 0"), s.filter("month(start_ts) = 3 AND month(end_ts) = 4"))


@query(
    "out_of_sample_split",
    "daily",
    """, s7 AS (SELECT a.t AS sample, a.t AS first_t, a.t + 6 AS last_t, month(a.ts) IN (3, 6, 9, 12) AND month(b.ts) IN (3, 6, 9, 12) AS tst, month(a.ts) NOT IN (3, 6, 9, 12) AND month(b.ts) NOT IN (3, 6, 9, 12) AS rst
  FROM (SELECT DISTINCT t, ts FROM daily) a JOIN (SELECT DISTINCT t, ts FROM daily) b ON b.t = a.t + 6),
sz AS (SELECT CAST(floor(floor(count(*) FILTER (rst) * 0.1) / 4) AS BIGINT) AS size FROM s7),
hd AS (SELECT sample - 7 AS stop FROM (SELECT sample, sample - lag(sample) OVER (ORDER BY sample) AS gap FROM s7 WHERE tst) WHERE gap IS NULL OR gap > 1),
vi AS (SELECT DISTINCT ((s % n) + n) % n AS sample FROM (SELECT unnest(range(stop - size, stop)) AS s FROM hd, sz), (SELECT count(*) AS n FROM s7)),
val AS (SELECT s7.* FROM s7 SEMI JOIN vi ON vi.sample = s7.sample WHERE rst)
SELECT sample, 'test' AS phase FROM s7 WHERE tst UNION ALL SELECT sample, 'val' FROM val
UNION ALL SELECT sample, 'train' FROM s7 WHERE rst AND NOT EXISTS (SELECT 1 FROM val v WHERE v.first_t <= s7.last_t AND s7.first_t <= v.last_t)""",
)
def out_of_sample_split(spark, sf):
    return split.out_of_sample(split.samples(panels.daily_orders(spark, sf), 7), 7)


@query(
    "month_shift_mask",
    "daily",
    ", mo AS (SELECT DISTINCT year(ts) * 12 + month(ts) - 1 AS m FROM daily), gm AS (SELECT m AS dest, coalesce(lead(m) OVER (ORDER BY m), min(m) OVER ()) AS m FROM mo), "
    "l AS (SELECT node, ts + to_months(CAST(dest - gm.m AS INTEGER)) AS ts, arg_min(observed, t) AS later FROM daily JOIN gm ON gm.m = year(ts) * 12 + month(ts) - 1 GROUP BY 1, 2) SELECT d.node, d.t, d.observed AND NOT coalesce(l.later, true) AS eval FROM daily d LEFT JOIN l ON l.node = d.node AND l.ts = d.ts",
)
def month_shift_mask(spark, sf):
    return split.month_shift_mask(panels.daily_orders(spark, sf)).select("node", "t", "eval")


# Distances, affinities, spatial graphs


@query("haversine_pairs", "geo", "SELECT src, dst, round(d, 6) AS d FROM geo")
def haversine_pairs(spark, sf):
    return rounded(spatial.haversine(panels.stations(spark, sf)), "d")


@query("masked_euclidean", "dist", "SELECT src, dst, round(d, 6) AS d FROM dist")
def masked_euclidean(spark, sf):
    return rounded(spatial.masked_euclidean(_panel(spark, sf)), "d")


@query(
    "correlation_distance",
    "panel",
    "SELECT a.node AS src, b.node AS dst, round(1 - abs(corr(a.value, b.value)), 6) AS d FROM panel a JOIN panel b ON a.t = b.t AND a.node < b.node WHERE a.observed AND b.observed GROUP BY 1, 2 HAVING count(*) > 2",
)
def correlation_distance(spark, sf):
    p = panels.hourly(spark, sf)
    common = p.filter("observed").select("t", F.col("node").alias("src")).join(p.filter("observed").select("t", F.col("node").alias("dst")), "t").filter("src < dst").groupBy("src", "dst").count().filter("count > 2")
    return rounded(spatial.correlation_distance(p).join(common, ["src", "dst"], "left_semi"), "d")


def _vector_query(metric: str, form: str):
    @query(f"{metric}_neighbours", "vec", f", pr AS (SELECT a.id AS dst, b.id AS src, round({form}, 9) AS d FROM vec a, vec b WHERE a.id <> b.id) SELECT src, dst, round(d, 6) AS d, rank FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY d, src) AS rank FROM pr) WHERE rank <= 5")
    def knn(spark, sf):
        return vectors.knn(panels.vectors(spark, sf), 5, metric, digits=9).select("src", "dst", r6("d", "d"), "rank")


_vector_query("euclidean", "list_distance(a.v, b.v)")
_vector_query("cosine", "1 - list_cosine_similarity(a.v, b.v)")
_vector_query("chebyshev", "list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))")


@query(
    "radius_graph",
    "vec",
    ", pr AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.id < b.id), r AS (SELECT min(d) + 0.1 * (max(d) - min(d)) AS r FROM pr) SELECT src, dst, round(d, 6) AS d FROM pr, r WHERE d <= r",
)
def radius_graph(spark, sf):
    return rounded(vectors.radius_graph(panels.vectors(spark, sf), 0.1), "d")


@query("gaussian_affinity", "aff", "SELECT src, dst, round(weight, 6) AS weight FROM aff")
def gaussian_affinity(spark, sf):
    return rounded(spatial.gaussian(spatial.masked_euclidean(_panel(spark, sf)), gamma=0.1), "weight")


@query("gaussian_affinity_median", "geo", ", m AS (SELECT quantile_disc(d, 0.5) AS theta FROM geo WHERE d > 0) SELECT src, dst, round(exp(-pow(d / theta, 2)), 6) AS weight FROM geo, m WHERE d > 0")
def gaussian_affinity_median(spark, sf):
    return rounded(spatial.gaussian(spatial.haversine(panels.stations(spark, sf)), theta="median"), "weight")


_GEO_AFF = ", f AS (SELECT stddev_samp(d) AS theta FROM (SELECT d FROM geo UNION ALL SELECT 0 FROM st)), ga AS (SELECT src, dst, exp(-pow(d / theta, 2)) AS weight FROM geo, f WHERE d > 0)"


def _geo_affinity(spark, sf):
    st = panels.stations(spark, sf)
    return spatial.gaussian(spatial.haversine(st), diagonal=st.count())


@query("geo_affinity", "geo", _GEO_AFF + " SELECT src, dst, round(weight, 6) AS weight FROM ga WHERE weight >= 0.1")
def geo_affinity(spark, sf):
    return rounded(_geo_affinity(spark, sf).filter("weight >= 0.1"), "weight")


@query(
    "geo_topk",
    "geo",
    _GEO_AFF + ", gr AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM (SELECT src, dst, round(weight, 9) AS w FROM ga)) SELECT src, dst, 1.0::DOUBLE AS weight FROM gr WHERE r <= 4",
)
def geo_topk(spark, sf):
    return spatial.top_k(_geo_affinity(spark, sf).withColumn("weight", F.round("weight", 9)), 4, symmetric=False, binary=True)


@query("similarity_graph", "graph", "SELECT src, dst, round(weight, 6) AS weight FROM graph")
def similarity_graph(spark, sf):
    return rounded(_graph(spark, sf), "weight")


_TAU = "(SELECT quantile_disc(round(weight, 9), 0.9) FROM aff)"


@query("threshold_graph", "aff", f"SELECT src, dst, 1.0::DOUBLE AS weight FROM aff WHERE round(weight, 9) >= {_TAU}")
def threshold_graph(spark, sf):
    """The heaviest tenth of the affinities."""
    weights = stored(_weights(_panel(spark, sf)), "affinity")
    tau = weights.agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY weight)")).first()[0]
    return spatial.threshold(weights, tau)


@query("symmetrize", "aff", "SELECT src, dst, round(max(weight), 6) AS weight FROM (SELECT src, dst, weight FROM aff WHERE src < dst UNION ALL SELECT dst, src, weight FROM aff WHERE src < dst) GROUP BY 1, 2")
def symmetrize(spark, sf):
    return rounded(spatial.symmetrize(spatial.gaussian(stored(spatial.masked_euclidean(_panel(spark, sf)), "distances"), gamma=0.1).filter("src < dst")), "weight")


@query("complete_graph", "st", "SELECT a.node AS src, b.node AS dst, 1.0::DOUBLE AS weight FROM st a JOIN st b ON a.node <> b.node")
def complete_graph(spark, sf):
    return spatial.complete_graph(panels.stations(spark, sf))


@query("edge_set_overlap", "graph", f", tg AS (SELECT src, dst FROM aff WHERE round(weight, 9) >= {_TAU}) SELECT count(g.src) AS left, count(t.src) AS right, count(*) FILTER (g.src IS NOT NULL AND t.src IS NOT NULL) AS both, count(*) AS either, "
    "count(*) FILTER (g.src IS NOT NULL AND t.src IS NOT NULL) / nullif(count(*), 0) AS jaccard FROM graph g FULL JOIN tg t ON g.src = t.src AND g.dst = t.dst")  # fmt: skip
def edge_set_overlap(spark, sf):
    return profile.edge_sets(_graph(spark, sf), threshold_graph(spark, sf))


# Temporal graphs


@query("khop_graph", "ser", "SELECT a.series, a.t AS src, b.t AS dst, round(pow(0.9, b.t - a.t), 6) AS weight FROM ser a JOIN ser b ON a.series = b.series AND b.t BETWEEN a.t + 1 AND a.t + 4")
def khop_graph(spark, sf):
    return rounded(temporal.khop(_series(spark, sf), 4), "weight")


_SEEN = "SELECT a.series, a.t AS src, b.t AS dst, {w} AS weight FROM ser a JOIN ser b ON a.series = b.series AND b.t BETWEEN a.t + 1 AND a.t + 32 WHERE NOT EXISTS (SELECT 1 FROM ser k WHERE k.series = a.series AND k.t > a.t AND k.t < b.t AND {blocked})"


@query("horizontal_visibility", "ser", _SEEN.format(w="least(a.x, b.x)", blocked="(k.x >= a.x OR k.x >= b.x)"))
def horizontal_visibility(spark, sf):
    return temporal.visibility(_series(spark, sf), "horizontal", limit=32)


@query("natural_visibility", "ser", _SEEN.format(w="abs((b.x - a.x) / (b.t - a.t))", blocked="k.x >= b.x + (a.x - b.x) * (b.t - k.t) / (b.t - a.t)"))
def natural_visibility(spark, sf):
    return temporal.visibility(_series(spark, sf), "natural", limit=32)


@query("horizontal_visibility_all")
def horizontal_visibility_all(spark, sf):
    """Rows only: edges of any length."""
    return temporal.visibility(_series(spark, sf), "horizontal")


@query("natural_visibility_all")
def natural_visibility_all(spark, sf):
    """Rows only: edges of any length."""
    return temporal.visibility(_series(spark, sf), "natural")


@query(
    "chunked_visibility",
    "ser",
    ", ch AS (SELECT series, c, t, x FROM (SELECT *, unnest(range(CAST(greatest(0, floor((t - 48) / 24.0) + 1) AS BIGINT), t // 24 + 1)) AS c FROM ser)), ok AS (SELECT series, c FROM ch GROUP BY 1, 2 HAVING count(*) >= 3), "
    "e AS (SELECT a.series, a.c, a.t AS src, b.t AS dst, least(a.x, b.x) AS w FROM ch a JOIN ch b ON a.series = b.series AND a.c = b.c AND b.t BETWEEN a.t + 1 AND a.t + 32 SEMI JOIN ok ON ok.series = a.series AND ok.c = a.c "
    "WHERE NOT EXISTS (SELECT 1 FROM ch k WHERE k.series = a.series AND k.c = a.c AND k.t > a.t AND k.t < b.t AND (k.x >= a.x OR k.x >= b.x))) SELECT series, src, dst, round(avg(w), 6) AS weight FROM e GROUP BY 1, 2, 3",
)
def chunked_visibility(spark, sf):
    return rounded(temporal.chunked_visibility(_series(spark, sf), 48, 24, limit=32), "weight")


@query("takens", "ser", "SELECT a.series, a.t, [a.x, b.x, c.x] AS v FROM ser a JOIN ser b ON b.series = a.series AND b.t = a.t + 2 JOIN ser c ON c.series = a.series AND c.t = a.t + 4")
def takens(spark, sf):
    return temporal.takens(_series(spark, sf), 3, 2)


_TK = ", tk AS (SELECT a.series, a.t, a.x AS x0, b.x AS x1 FROM ser a JOIN ser b ON b.series = a.series AND b.t = a.t + 1) "


@query("recurrence_graph", "ser", _TK + "SELECT a.series, a.t AS src, b.t AS dst, 1.0::DOUBLE AS weight FROM tk a JOIN tk b ON a.series = b.series AND a.t < b.t WHERE greatest(abs(a.x0 - b.x0), abs(a.x1 - b.x1)) < 1.0")
def recurrence_graph(spark, sf):
    return temporal.recurrence(_series(spark, sf), radius=1.0, dim=2, lag=1)


@query("theiler_neighbours", "ser", _TK + "SELECT a.series, a.t AS src, b.t AS dst FROM tk a JOIN tk b ON a.series = b.series AND b.t - a.t > 24 WHERE greatest(abs(a.x0 - b.x0), abs(a.x1 - b.x1)) < 1.0")
def theiler_neighbours(spark, sf):
    return temporal.neighbours(temporal.takens(_series(spark, sf), 2), 1.0, theiler=24)


@query("phase_diameter", "ser", _TK + "SELECT series, round(sqrt(pow(max(x0) - min(x0), 2) + pow(max(x1) - min(x1), 2)), 6) AS diameter FROM tk GROUP BY 1")
def phase_diameter(spark, sf):
    return rounded(temporal.diameter(temporal.takens(_series(spark, sf), 2), 2), "diameter")


_BINS = ", qe AS (SELECT series, unnest(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) AS e FROM ser GROUP BY 1), bn AS (SELECT s.series, s.t, (SELECT count(*) FROM qe WHERE qe.series = s.series AND qe.e < s.x) AS bin FROM ser s)"


@query("quantile_bins", "ser", _BINS + " SELECT series, t, bin FROM bn")
def quantile_bins(spark, sf):
    return temporal.quantile_bins(_series(spark, sf), 5).select("series", "t", F.col("bin").cast("long").alias("bin"))


@query(
    "transition_graph",
    "ser",
    _BINS + ", nx AS (SELECT series, bin AS src, lead(bin) OVER (PARTITION BY series ORDER BY t) AS dst FROM bn) SELECT series, src, dst, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY series, src), 6) AS weight FROM nx WHERE dst IS NOT NULL GROUP BY 1, 2, 3",
)
def transition_graph(spark, sf):
    out = temporal.transitions(temporal.quantile_bins(_series(spark, sf), 5))
    return out.select("series", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "n", r6("weight", "weight"))


@query(
    "quantile_graph",
    "ser",
    _BINS + ", nx AS (SELECT series, bin AS b1, lead(bin) OVER (PARTITION BY series ORDER BY t) AS b2 FROM bn), tr AS (SELECT series, b1, b2, count(*) / sum(count(*)) OVER (PARTITION BY series, b1) AS w FROM nx WHERE b2 IS NOT NULL GROUP BY 1, 2, 3) "
    "SELECT a.series, a.t AS src, count(*) AS n, round(sum(w), 6) AS weight FROM tr JOIN bn a ON a.series = tr.series AND a.bin = tr.b1 JOIN bn b ON b.series = tr.series AND b.bin = tr.b2 WHERE a.t <> b.t GROUP BY 1, 2",
)
def quantile_graph(spark, sf):
    return temporal.quantile_graph(_series(spark, sf), 5).groupBy("series", "src").agg(F.count("*").alias("n"), r6(F.sum("weight"), "weight"))


@query("cao_dimension")
def cao_dimension(spark, sf):
    """Rows only: an iterative estimate for each series."""
    return temporal.cao_dimension(_series(spark, sf))


# Overlapping predictions, propagation, scores


def _predictions(spark, sf):
    p = panels.by_type(spark, sf)
    s = split.samples(p, 36)
    window = split.members(s).join(p.select("t", "node", "value"), "t").groupBy("sample", "node").agg(F.avg("value").alias("prediction"))
    return split.members(s).join(window, "sample").select("sample", "t", "node", "prediction")


def _overlap_query(how: str, body: str):
    @query(f"overlap_{how}", "pred", body)
    def overlap(spark, sf):
        out = scores.overlap(_predictions(spark, sf), how)
        return rounded(out, "prediction", digits=9) if "mean" in how or "smooth" in how else out


_NUMBERED = ", nb AS (SELECT *, row_number() OVER (PARTITION BY node, t ORDER BY sample) - 1 AS i, count(*) OVER (PARTITION BY node, t) AS n FROM pred) "
_overlap_query("mean", "SELECT node, t, round(avg(prediction), 9) AS prediction FROM pred GROUP BY 1, 2")
_overlap_query("last", "SELECT node, t, arg_min(prediction, sample) AS prediction FROM pred WHERE prediction IS NOT NULL GROUP BY 1, 2")
_overlap_query("central", _NUMBERED + "SELECT node, t, prediction FROM nb WHERE i = n // 2")
_overlap_query("smooth_central", _NUMBERED + "SELECT node, t, round(sum(exp(-0.5 * pow(i - (n - 1) / 2, 2)) * prediction) / sum(exp(-0.5 * pow(i - (n - 1) / 2, 2))), 9) AS prediction FROM nb GROUP BY 1, 2")

_SUP = ", sup AS (SELECT 'forward' AS way, src, dst, weight / (sum(weight) OVER (PARTITION BY src) + 1e-6) AS weight FROM graph UNION ALL SELECT 'backward', dst, src, weight / (sum(weight) OVER (PARTITION BY dst) + 1e-6) FROM graph)"


@query("diffusion_supports", "graph", _SUP + " SELECT way, src, dst, round(weight, 6) AS weight FROM sup")
def diffusion_supports(spark, sf):
    return rounded(propagate.supports(_graph(spark, sf)), "weight")


@query("second_order_support", "graph", _SUP + " SELECT a.way, a.src, b.dst, round(sum(a.weight * b.weight), 6) AS weight FROM sup a JOIN sup b ON a.way = b.way AND a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2, 3")
def second_order_support(spark, sf):
    return rounded(propagate.power(propagate.supports(_graph(spark, sf)), 2), "weight")


@query("graph_convolution", "graph", _SUP + " SELECT way, t, src AS node, round(sum(weight * CASE WHEN train THEN value ELSE 0 END), 6) AS y FROM sup JOIN panel p ON p.node = sup.dst GROUP BY 1, 2, 3")
def graph_convolution(spark, sf):
    g, p = _both(spark, sf)
    return rounded(propagate.convolve(propagate.supports(g), p), "y")


_GCN = ", gn AS (SELECT g.src, g.dst, g.weight / sqrt(a.strength * b.strength) AS w FROM graph g JOIN deg a ON a.node = g.src JOIN deg b ON b.node = g.dst), gy AS (SELECT t, dst AS node, sum(w * CASE WHEN train THEN value ELSE 0 END) AS y FROM gn JOIN panel p ON p.node = gn.src GROUP BY 1, 2)"


@query("gcn_propagate", "deg", _GCN + " SELECT t, node, round(y, 6) AS y FROM gy")
def gcn_propagate(spark, sf):
    return rounded(propagate.gcn(*_both(spark, sf)), "y")


@query("gcn_affine_fit", "deg", _GCN + " SELECT round(regr_slope(value, y), 6) AS slope, round(regr_intercept(value, y), 6) AS intercept FROM gy JOIN panel p ON p.t = gy.t AND p.node = gy.node WHERE train")
def gcn_affine_fit(spark, sf):
    g, p = _both(spark, sf)
    rows = propagate.gcn(g, p).join(p.filter("train").select("t", "node", "value"), ["t", "node"])
    return rounded(propagate.affine_fit(rows), "slope", "intercept")


def _imputed(spark, sf):
    return propagate.impute(*_both(spark, sf))


@query("impute_neighbours", "imp", "SELECT node, t, round(CASE WHEN observed THEN value ELSE prediction END, 6) AS output FROM imp")
def impute_neighbours(spark, sf):
    return propagate.fill_holes(_imputed(spark, sf)).select("node", "t", r6("output", "output"))


_SCORED = ", sc AS (SELECT t, node, prediction AS p, value AS v FROM imp WHERE eval) "


def _scored(spark, sf):
    return _imputed(spark, sf).filter("eval").select("t", "node", "prediction", F.col("value").alias("target"))


@query(
    "metrics_pointwise",
    "imp",
    _SCORED
    + "SELECT count(*) AS n, round(avg(abs(p - v)), 6) AS mae, round(avg((p - v) * (p - v)), 6) AS mse, round(sqrt(avg((p - v) * (p - v))), 6) AS rmse, round(avg(CASE WHEN v <> 0 THEN abs((p - v) / v) END), 6) AS mape, "
    "round(CASE WHEN sum(v) > 1e-6 THEN sum(abs(p - v)) / sum(v) ELSE sum(abs(p - v)) END, 6) AS mre, round(avg(abs(p - v) / (abs(v) + 1e-6)), 6) AS mre2, "
    "round(avg(CASE WHEN abs(p) + abs(v) > 1e-6 THEN 2 * abs(p - v) / (abs(p) + abs(v) + 1e-6) ELSE 0 END), 6) AS smape, round(sum(abs(p - v)) / sum(v), 6) AS wape, round(avg(abs(p - v)) / (max(v) - min(v)), 6) AS nmae, "
    "round(sqrt(avg((p - v) * (p - v))) / (max(v) - min(v)), 6) AS nrmse, round(sqrt(sum((p - v) * (p - v)) / sum(v * v)), 6) AS nrmse_2, round(1 - sum((p - v) * (p - v)) / (sum(v * v) - sum(v) * sum(v) / count(v)), 6) AS r2 FROM sc",
)
def metrics_pointwise(spark, sf):
    out = scores.errors(_scored(spark, sf))
    return rounded(out, *(c for c in out.columns if c != "n"))


@query(
    "metrics_correlation",
    "imp",
    _SCORED
    + ", m AS (SELECT avg(p) AS mp, avg(v) AS mv, avg(p * v) AS pv, avg(p * p) AS pp, avg(v * v) AS vv, sum(p * v) AS s, sum(p * p) AS sp, sum(v * v) AS sv FROM sc) SELECT round((pv - mp * mv) / greatest(sqrt(greatest(pp - mp * mp, 0)) * sqrt(greatest(vv - mv * mv, 0)), 1e-6), 6) AS pearson, "
    "round(2 * (pv - mp * mv) / (greatest(pp - mp * mp, 0) + greatest(vv - mv * mv, 0) + (mp - mv) * (mp - mv) + 1e-8), 6) AS ccc, round(s / (sqrt(sp) * sqrt(sv) + 1e-8), 6) AS cosine FROM m",
)
def metrics_correlation(spark, sf):
    return rounded(scores.correlations(_scored(spark, sf)), "pearson", "ccc", "cosine")


@query(
    "lag_correlation",
    "imp",
    _SCORED + ", lg AS (SELECT p, lag(v, 1) OVER (PARTITION BY node ORDER BY t) AS y FROM sc) SELECT round(corr(p, y), 6) AS lag FROM lg WHERE y IS NOT NULL",
)
def lag_correlation(spark, sf):
    return rounded(scores.lag_correlation(_scored(spark, sf)), "lag")


@query("metrics_by_node", "imp", _SCORED + "SELECT node, count(*) AS n, round(avg(abs(p - v)), 6) AS mae, round(sqrt(avg((p - v) * (p - v))), 6) AS rmse FROM sc GROUP BY 1")
def metrics_by_node(spark, sf):
    return rounded(scores.errors(_scored(spark, sf), ["node"]).select("node", "n", "mae", "rmse"), "mae", "rmse")


@query("runtime_metrics", "", "SELECT round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events")
def runtime_metrics(spark, sf):
    out = scores.runtimes(panels.read(spark, sf, "events"), "value")
    return out.select(r6("total", "total", 4), r6("mean", "mean"), r6("std", "std"))


# Profiles


@query("degrees", "deg", "SELECT node, degree, round(strength, 6) AS strength FROM deg")
def degrees(spark, sf):
    return rounded(profile.degrees(_graph(spark, sf)), "strength")


_SPREAD = "round(avg({c}), 6) AS avg_{p}, round(median({c}), 6) AS median_{p}, round(min({c}), 6) AS min_{p}, round(max({c}), 6) AS max_{p}, round(stddev_pop({c}), 6) AS std_{p}"


def _spread_query(name: str, table: str, column: str, prefix: str, rows: Query):
    @query(name, table, f"SELECT {_SPREAD.format(c=column, p=prefix)} FROM {table}")
    def stats(spark, sf):
        out = profile.spread(rows(spark, sf), column, prefix)
        return out.select(*(r6(F.col(c).cast("double"), c) for c in out.columns))


_spread_query("degree_stats", "deg", "CAST(degree AS DOUBLE)", "degree", lambda spark, sf: profile.degrees(_graph(spark, sf)).withColumn("CAST(degree AS DOUBLE)", F.col("degree").cast("double")))
_spread_query("strength_stats", "deg", "strength", "strength", lambda spark, sf: profile.degrees(_graph(spark, sf)))
_spread_query("edge_weight_stats", "und", "weight", "weight", lambda spark, sf: profile.undirected(_graph(spark, sf)))


@query("graph_counts", "und", "SELECT n AS nodes, m AS edges, round(2 * m / (n * (n - 1)), 6) AS density FROM (SELECT count(DISTINCT src) AS n FROM graph), (SELECT count(*) AS m FROM und)")
def graph_counts(spark, sf):
    return rounded(profile.counts(_graph(spark, sf)), "density")


_TRI = ", tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c, x.weight AS wab, y.weight AS wbc, z.weight AS wac FROM und x JOIN und y ON y.src = x.dst JOIN und z ON z.src = x.src AND z.dst = y.dst)"


@query("triangles", "und", _TRI + " SELECT a, b, c FROM tri")
def triangles(spark, sf):
    return profile.triangles(_graph(spark, sf)).select("a", "b", "c")


@query(
    "clustering",
    "und deg",
    _TRI + ", tw AS (SELECT unnest([a, b, c]) AS node, cbrt((wab / m) * (wbc / m) * (wac / m)) AS w FROM tri, (SELECT max(weight) AS m FROM graph)), ta AS (SELECT node, count(*) AS n, sum(w) AS w FROM tw GROUP BY 1) "
    "SELECT deg.node, round(CASE WHEN degree > 1 THEN coalesce(2 * n / (degree * (degree - 1)), 0) ELSE 0 END, 6) AS clustering, round(CASE WHEN degree > 1 THEN coalesce(2 * w / (degree * (degree - 1)), 0) ELSE 0 END, 6) AS weighted FROM deg LEFT JOIN ta ON ta.node = deg.node",
)
def clustering(spark, sf):
    return rounded(profile.clustering(_graph(spark, sf)), "clustering", "weighted")


_REACH = """WITH RECURSIVE {head}, reach AS (SELECT src AS node, dst AS far FROM graph UNION SELECT r.node, g.dst FROM reach r JOIN graph g ON g.src = r.far), comp AS (SELECT node, least(node, min(far)) AS component FROM reach GROUP BY node) """


def _recursive(body: str) -> str:
    return _REACH.format(head=sql("und", "")[5:].strip()) + body


@query("components")
def components(spark, sf):
    return profile.components(_graph(spark, sf))


ORACLE["components"] = _recursive("SELECT node, component FROM comp")


@query("component_profile")
def component_profile(spark, sf):
    return rounded(profile.component_profile(_graph(spark, sf)), "share", "density", "clustering")


ORACLE["component_profile"] = _recursive(
    ", sz AS (SELECT component, count(*) AS nodes FROM comp GROUP BY 1), ed AS (SELECT component, count(*) AS edges FROM und JOIN comp ON comp.node = und.src GROUP BY 1), "
    "dg AS (SELECT src AS node, count(*) AS degree FROM graph GROUP BY 1), tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM und x JOIN und y ON y.src = x.dst JOIN und z ON z.src = x.src AND z.dst = y.dst), tn AS (SELECT node, count(*) AS n FROM (SELECT unnest([a, b, c]) AS node FROM tri) GROUP BY 1), "
    "cl AS (SELECT component, avg(CASE WHEN degree > 1 THEN coalesce(2 * n / (degree * (degree - 1)), 0) ELSE 0 END) AS clustering FROM dg JOIN comp ON comp.node = dg.node LEFT JOIN tn ON tn.node = dg.node GROUP BY 1) SELECT sz.component, CAST(row_number() OVER (ORDER BY nodes DESC, sz.component) - 1 AS INT) AS component_id, nodes, "
    "round(nodes / (SELECT sum(nodes) FROM sz), 6) AS share, edges, round(2 * edges / (nodes * (nodes - 1)), 6) AS density, round(clustering, 6) AS clustering FROM sz JOIN ed ON ed.component = sz.component JOIN cl ON cl.component = sz.component"
)

_HOPS = "hp AS (SELECT src, dst, 1 AS hops FROM graph UNION SELECT h.src, g.dst, h.hops + 1 FROM hp h JOIN graph g ON g.src = h.dst WHERE h.hops < 36), sh AS (SELECT src, dst, min(hops) AS hops FROM hp WHERE src <> dst GROUP BY 1, 2)"


@query("hop_paths")
def hop_paths(spark, sf):
    return profile.hop_paths(_graph(spark, sf))


ORACLE["hop_paths"] = f"WITH RECURSIVE {sql('graph', '')[5:].strip()}, {_HOPS} SELECT src, dst, hops FROM sh"


@query("path_profile")
def path_profile(spark, sf):
    return rounded(profile.path_profile(profile.hop_paths(_graph(spark, sf))), "avg_path", "avg_eccentricity", "avg_closeness")


ORACLE["path_profile"] = (
    f"WITH RECURSIVE {sql('graph', '')[5:].strip()}, {_HOPS}, bn AS (SELECT src, max(hops) AS ecc, sum(hops) AS far, count(*) AS reach FROM sh GROUP BY 1) "
    "SELECT round(sum(far) / sum(reach), 6) AS avg_path, max(ecc) AS diameter, min(ecc) AS radius, round(avg(ecc), 6) AS avg_eccentricity, round(avg(reach / far), 6) AS avg_closeness FROM bn"
)


@query("assortativity", "deg", "SELECT round(coalesce(corr(a.degree, b.degree), 0), 6) AS assortativity FROM graph g JOIN deg a ON a.node = g.src JOIN deg b ON b.node = g.dst")
def assortativity(spark, sf):
    return rounded(profile.assortativity(_graph(spark, sf)), "assortativity")


@query(
    "edge_smoothness",
    "graph",
    ", rg AS (SELECT a.t, sum(g.weight * (a.value - b.value) * (a.value - b.value)) AS rough FROM graph g JOIN panel a ON a.node = g.src JOIN panel b ON b.node = g.dst AND b.t = a.t WHERE a.observed AND b.observed GROUP BY 1), en AS (SELECT t, sum(value * value) AS energy FROM panel WHERE observed GROUP BY 1) "
    "SELECT en.t, round(coalesce(rough, 0) / (energy + 1e-8), 6) AS smoothness FROM en LEFT JOIN rg ON rg.t = en.t",
)
def edge_smoothness(spark, sf):
    return rounded(profile.edge_smoothness(*_both(spark, sf)), "smoothness")


@query(
    "laplacian_smoothness",
    "deg",
    ", u AS (SELECT p.t, p.node, CASE WHEN train THEN value ELSE 0 END AS x, CASE WHEN train THEN value ELSE 0 END / sqrt(strength) AS u FROM panel p LEFT JOIN deg ON deg.node = p.node), rg AS (SELECT a.t, sum(g.weight * (a.u - b.u) * (a.u - b.u)) / 2 AS rough FROM graph g JOIN u a ON a.node = g.src JOIN u b ON b.node = g.dst AND b.t = a.t GROUP BY 1), "
    "en AS (SELECT t, sum(x * x) AS energy, sum(CASE WHEN u IS NULL THEN x * x ELSE 0 END) AS alone FROM u GROUP BY 1) SELECT en.t, round((coalesce(rough, 0) + alone) / (energy + 1e-8), 6) AS smoothness FROM en LEFT JOIN rg ON rg.t = en.t",
)
def laplacian_smoothness(spark, sf):
    return rounded(profile.laplacian_smoothness(*_both(spark, sf)), "smoothness")


@query("modularity", "graph", ", bp AS (SELECT g.src % 3 AS a, sum(CASE WHEN g.src % 3 = g.dst % 3 THEN weight ELSE 0 END) AS inside, sum(weight) AS total FROM graph g GROUP BY 1) SELECT round(sum(inside / m - (total / m) * (total / m)), 6) AS modularity FROM bp, (SELECT sum(total) AS m FROM bp)")
def modularity(spark, sf):
    g = _graph(spark, sf)
    return rounded(profile.modularity(g, profile.nodes_of(g).withColumn("part", F.col("node") % 3)), "modularity")


@query("dense_profile")
def dense_profile(spark, sf):
    """Rows only: spectra, weighted paths, betweenness and communities of each component's matrix."""
    g = _graph(spark, sf)
    return profile.dense_profile(g, profile.components(g))


@query("eigenvector_centrality")
def eigenvector_centrality(spark, sf):
    return rounded(profile.eigenvector_centrality(_graph(spark, sf)), "x")


@query("small_world")
def small_world(spark, sf):
    return rounded(profile.small_world(_graph(spark, sf)), "c", "avg_path", "c_random", "path_random", "sigma")
