"""One query for each operator, over the data folder, and its equal in DuckDB SQL where there is one."""

from pyspark.sql import functions as F

from .functions import vector as V
from .operators import approximate, density, frozen, fusion, hierarchy, linkage, metrics, neighbours, spectral
from .operators.storage import Store
from .plans import harness, methods, prefixes, reports
from .sources import streams

QUERIES, SQL = {}, {}

POINTS = """points AS (SELECT vec_id AS seq, label::BIGINT AS label, list_transform(embedding, lambda x: (x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12))::FLOAT)::DOUBLE[] AS e FROM embeddings),
pairs AS (SELECT a.seq AS i, b.seq AS j, a.label AS li, b.label AS lj, list_dot_product(a.e, b.e) AS dot, 1 - greatest(-1, least(1, list_dot_product(a.e, b.e))) AS distance FROM points a JOIN points b ON a.seq < b.seq),
both_ways AS (SELECT i, j, distance FROM pairs UNION ALL SELECT j, i, distance FROM pairs),
sums AS (SELECT label, pos, sum(v) AS s, count(*) AS n FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS pos FROM points) GROUP BY label, pos),
reps AS (SELECT label, any_value(n) AS n, list_transform(list(s ORDER BY pos), lambda x: (x / greatest(sqrt(sum2), 1e-12))::FLOAT)::DOUBLE[] AS rep FROM sums JOIN (SELECT label, sum(s * s) AS sum2 FROM sums GROUP BY label) USING (label) GROUP BY label, sum2),
scored AS (SELECT seq, r.label AS r, round(1 - greatest(-1, least(1, list_dot_product(e, rep))), 9) AS d, row_number() OVER (PARTITION BY seq ORDER BY round(1 - greatest(-1, least(1, list_dot_product(e, rep))), 9), r.label) AS k FROM points, reps r),
two AS (SELECT seq, max(CASE WHEN k = 1 THEN r END) AS nearest, max(CASE WHEN k = 1 THEN d END) AS best, max(CASE WHEN k = 2 THEN d END) AS second FROM scored GROUP BY seq),
spread AS (SELECT label, quantile_cont(1 - greatest(-1, least(1, list_dot_product(e, rep))), 0.95) AS spread FROM points JOIN reps USING (label) GROUP BY label)"""


def query(sql: str | None = None, points: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH RECURSIVE {POINTS} {sql}" if points else sql)
        return f

    return add


def _points(spark, sf):
    return streams.stream(spark, f"{sf}/embeddings.parquet")


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT count(*) AS n_rows, min(len(e)) AS min_dim, max(len(e)) AS max_dim, count(DISTINCT label) AS n_labels, round(min(sqrt(list_dot_product(e, e))), 6) AS min_norm, round(max(sqrt(list_dot_product(e, e))), 6) AS max_norm, true AS all_finite FROM points")
def dataset_profile(spark, sf):
    return streams.profile(_points(spark, sf))


@query("SELECT label, count(*) AS n FROM points GROUP BY label")
def class_histogram(spark, sf):
    return _points(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT seq, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1], 6) AS first, round(e[64], 6) AS last FROM points")
def l2_normalize(spark, sf):
    p = _points(spark, sf)
    return p.select("seq", F.round(V.norm("embedding"), 6).alias("norm"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"), F.round(F.col("embedding")[63].cast("double"), 6).alias("last"))


@query("SELECT i, j, round(distance, 6) AS distance FROM pairs")
def pairwise_cosine(spark, sf):
    return neighbours.pairs(_points(spark, sf), digits=6)


@query("SELECT a.seq AS i, b.seq AS j, round(1 - list_dot_product(a.e, b.e), 6) AS unclipped, round(greatest(0, least(1, (list_dot_product(a.e, b.e) + 1) / 2)), 6) AS affinity FROM points a JOIN points b ON b.seq = a.seq + 1")
def neighbour_scalars(spark, sf):
    p = _points(spark, sf)
    n = p.select((F.col("seq") - 1).alias("seq"), F.col("seq").alias("j"), F.col("embedding").alias("b"))
    return p.join(n, "seq").select(F.col("seq").alias("i"), "j", F.round(V.cosine_distance("embedding", "b", False), 6).alias("unclipped"), F.round(V.affinity("embedding", "b"), 6).alias("affinity"))


@query("SELECT label, n, round(rep[1], 6) AS first, round(rep[64], 6) AS last FROM reps")
def representatives(spark, sf):
    return neighbours.representatives(_points(spark, sf)).select("label", "n", F.round(F.col("rep")[0].cast("double"), 6).alias("first"), F.round(F.col("rep")[63].cast("double"), 6).alias("last"))


@query("SELECT seq, nearest, round(best, 6) AS best, round(second, 6) AS second, best <= 0.75 AND round(second - best, 9) >= 0.02 AS confident FROM two")
def confidence_gate(spark, sf):
    p = _points(spark, sf)
    out = neighbours.gate(p, neighbours.representatives(p), 0.75)
    return out.select("seq", "nearest", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"), "confident")


@query("SELECT i, round(distance, 6) AS core FROM (SELECT i, distance, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS r FROM both_ways) WHERE r = 2")
def knn_core_distance(spark, sf):
    return neighbours.core_distances(_points(spark, sf), 2).select("i", F.round("core", 6).alias("core"))


@query("SELECT i, round(distance, 6) AS distance, r::INT AS r FROM (SELECT i, distance, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS r FROM both_ways) WHERE r <= 5")
def nearest_neighbours(spark, sf):
    near = neighbours.nearest(_points(spark, sf), 5)
    return near.select("i", F.posexplode("near").alias("r", "x")).select("i", F.round("x.distance", 6).alias("distance"), (F.col("r") + 1).alias("r"))


@query("WITH points AS (SELECT vec_id AS seq, list_transform(embedding, lambda x: (x::DOUBLE / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12))::FLOAT)::DOUBLE[] AS e FROM embeddings), d AS MATERIALIZED (SELECT a.seq AS i, b.seq AS j, 1 - greatest(-1, least(1, list_dot_product(a.e, b.e))) AS distance FROM points a JOIN points b ON a.seq <> b.seq), core AS MATERIALIZED (SELECT i, distance AS c FROM (SELECT i, distance, row_number() OVER (PARTITION BY i ORDER BY distance, j) AS r FROM d) WHERE r = 2) SELECT d.i, d.j, round(greatest(distance, a.c, b.c), 6) AS reach FROM d JOIN core a ON a.i = d.i JOIN core b ON b.i = d.j WHERE d.i < d.j", False)
def mutual_reachability(spark, sf):
    return neighbours.mutual_reachability(_points(spark, sf), 2, digits=6)


_GRAPH = ", top AS (SELECT i, j, w FROM (SELECT i, j, (2 - distance) / 2 AS w, row_number() OVER (PARTITION BY i ORDER BY (2 - distance) / 2 DESC, j) AS r, count(*) OVER (PARTITION BY i) AS n FROM both_ways) WHERE r <= greatest(1, ceil(round(n * 0.2, 9)))), graph AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM top UNION ALL SELECT j, i, w FROM top) GROUP BY i, j) "


@query(_GRAPH + "SELECT i, j, round(w, 6) AS w FROM graph")
def affinity_graph(spark, sf):
    return neighbours.affinity_graph(_points(spark, sf), digits=6)


@query(_GRAPH + "SELECT i, round(greatest(1e-12, sum(w)), 6) AS degree FROM graph GROUP BY i")
def graph_degrees(spark, sf):
    return neighbours.graph_degrees(_points(spark, sf)).select("i", F.round("degree", 6).alias("degree"))


@query("SELECT label, round(spread, 6) AS spread FROM spread")
def cluster_spread_p95(spark, sf):
    p = _points(spark, sf)
    return neighbours.spread(p, neighbours.representatives(p)).select("label", F.round("spread", 6).alias("spread"))


@query("SELECT seq, CASE WHEN round(best, 6) <= round(1.5 * spread, 6) THEN nearest ELSE -1 END AS label FROM (SELECT seq, min(r) FILTER (k = 1) AS nearest, min(d) FILTER (k = 1) AS best FROM (SELECT seq, r, d, row_number() OVER (PARTITION BY seq ORDER BY d, r) AS k FROM scored WHERE r < 8 AND seq IN (SELECT seq FROM points WHERE label >= 8)) GROUP BY seq) JOIN spread ON label = nearest")
def noise_reinsertion(spark, sf):
    """The points of the labels from 8 on are taken for noise, and judged against the clusters of the others."""
    p = _points(spark, sf)
    return neighbours.reinsert_noise(p.where("label < 8"), p.where("label >= 8"))


@query("SELECT seq, CASE WHEN round(best, 6) <= round(1.5 * spread, 6) THEN nearest ELSE -1 END AS label FROM two JOIN spread ON label = nearest")
def noise_reinsertion_all(spark, sf):
    """Every point is judged, at the operator's own factor."""
    p = _points(spark, sf)
    return neighbours.reinsert_noise(p, p)


@query("SELECT label, i, j, similarity FROM (SELECT li AS label, i, j, round(dot, 6) AS similarity, row_number() OVER (PARTITION BY li ORDER BY round(dot, 6) DESC, i, j) AS r FROM pairs WHERE li = lj) WHERE r = 1")
def best_pair_per_label(spark, sf):
    return neighbours.best_pair(_points(spark, sf))


def _labelled(spark, sf):
    """Two labellings of documents: the true one is doc_id % 4, the predicted one of quality and toxic, with unknown rows as noise."""
    d, l = _t(spark, sf, "documents").select("doc_id", "lang"), _t(spark, sf, "labels")
    return d.join(l, "doc_id", "left").select(F.col("doc_id").alias("seq"), (F.col("doc_id") % 4).alias("label"), F.when(F.col("toxic").isNull(), -1).otherwise(F.col("quality") * 2 + F.col("toxic")).cast("long").alias("pred"))


_ROWS = "rows AS (SELECT doc_id AS seq, doc_id % 4 AS label, coalesce(quality * 2 + toxic, -1)::BIGINT AS pred FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT label, pred, count(*) AS n FROM rows GROUP BY label, pred)"


@query(f"WITH {_ROWS} SELECT * FROM c", False)
def contingency(spark, sf):
    return metrics.contingency(_labelled(spark, sf))


@query(f"""WITH {_ROWS}, t AS (SELECT label, sum(n) AS a FROM c GROUP BY label), p AS (SELECT pred, sum(n) AS b FROM c GROUP BY pred),
x AS (SELECT (SELECT sum(n)::DOUBLE FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS bo, (SELECT sum(n * (n - 1) / 2) FROM c WHERE pred >= 0) AS tp, (SELECT sum(n) FROM c WHERE pred >= 0) AS cov,
(SELECT sum(a * (a - 1) / 2) FROM t) AS same, (SELECT sum(b * (b - 1) / 2) FROM p) AS merged, (SELECT sum(b * (b - 1) / 2) FROM p WHERE pred >= 0) AS placed, (SELECT count(*) FROM p WHERE pred >= 0) AS k,
(SELECT -sum(a / s * ln(a / s)) FROM t, (SELECT sum(n)::DOUBLE AS s FROM c)) AS hu, (SELECT -sum(b / s * ln(b / s)) FROM p, (SELECT sum(n)::DOUBLE AS s FROM c)) AS hv,
(SELECT sum(n / s * ln(n * s / (a::DOUBLE * b))) FROM c JOIN t USING (label) JOIN p USING (pred), (SELECT sum(n)::DOUBLE AS s FROM c)) AS mi)
SELECT round(tp / placed, 9) AS pairwise_precision, round(tp / same, 9) AS pairwise_recall, round((placed - tp) / (n * (n - 1) / 2 - same), 9) AS false_merge_rate, round(cov / n, 9) AS coverage,
round((bo - same * merged / (n * (n - 1) / 2)) / ((same + merged) / 2 - same * merged / (n * (n - 1) / 2)), 9) AS ari, round(mi / ((hu + hv) / 2), 9) AS nmi, k AS cluster_count FROM x""", False)
def clustering_quality(spark, sf):
    return metrics.quality(_labelled(spark, sf))


@query(f"WITH {_ROWS} SELECT seq, label, pred FROM rows WHERE pred >= 0 UNION ALL SELECT seq, label, (SELECT max(pred) FROM rows) + row_number() OVER (ORDER BY seq) FROM rows WHERE pred < 0", False)
def noise_singletons(spark, sf):
    return metrics.noise_singletons(_labelled(spark, sf))


def _matching_sql(name: str, singles: str) -> str:
    """The largest matching of labels and clusters by trying all: labels in order, each with a free cluster, a singleton or none."""
    return f"""{name} AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS used, 0::BIGINT AS s UNION ALL
SELECT i + 1, CASE WHEN o.pred >= 0 THEN list_append(used, o.pred) ELSE used END, s + o.n FROM {name} JOIN (SELECT k, pred, n FROM c JOIN lab USING (label) WHERE pred >= 0 UNION ALL SELECT k, -1, {singles} FROM lab) o ON o.k = i + 1 WHERE NOT list_contains(used, o.pred))"""


@query(f"""WITH RECURSIVE {_ROWS}, lab AS (SELECT label, row_number() OVER (ORDER BY label) AS k FROM (SELECT DISTINCT label FROM c)),
{_matching_sql("strict", "0")}, {_matching_sql("single", "CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.label = lab.label AND pred < 0) THEN 1 ELSE 0 END")}
SELECT round((SELECT max(s) FROM strict) / (SELECT sum(n) FROM c), 9) AS cluster_accuracy, round((SELECT max(s) FROM strict) / (SELECT sum(n) FROM c WHERE pred >= 0), 9) AS cluster_accuracy_non_noise, round((SELECT max(s) FROM single) / (SELECT sum(n) FROM c), 9) AS cluster_accuracy_noise_singletons""", False)
def hungarian_accuracy(spark, sf):
    return metrics.accuracy(_labelled(spark, sf))


@query("SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5", False)
def round_robin_sample(spark, sf):
    return streams.round_robin(_t(spark, sf, "documents").select("lang", "doc_id"), "lang", "doc_id", 5).select("lang", "doc_id", "rank")


_SUM = "s AS (SELECT event_type AS method, round(avg(value), 6) AS ari, round(stddev_pop(value), 6) AS acc FROM events GROUP BY event_type)"


def _summaries(spark, sf):
    return _t(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.round(F.avg("value"), 6).alias("ari"), F.round(F.stddev_pop("value"), 6).alias("acc"))


@query(f"WITH {_SUM}, b AS (SELECT * FROM s WHERE method = (SELECT min(method) FROM s)) SELECT s.method, 'candidate' AS role, s.ari, s.acc, round(s.ari - b.ari, 6) AS ari_delta, round(s.acc - b.acc, 6) AS acc_delta FROM s, b", False)
def compare_to_baseline(spark, sf):
    s = _summaries(spark, sf)
    out = reports.compare(s, s.agg(F.min("method")).first()[0], ["ari", "acc"])
    return out.withColumns({c: F.round(c, 6) for c in ("ari_delta", "acc_delta")})


#: Event types in order stand for these methods; the last one's run has failed.
_NAMES = ["full_hdbscan", "fishdbc", "window_hdbscan", "own_method", "diart_style"]
_STEPS = f"""t AS (SELECT event_type, min(event_id) AS f, [{", ".join(f"'{m}'" for m in _NAMES)}][dense_rank() OVER (ORDER BY event_type)] AS method FROM events GROUP BY event_type),
s AS (SELECT method, CASE WHEN method = 'diart_style' THEN 'failed' ELSE 'ok' END AS status, round(avg(value) FILTER (event_id > f), 6) AS mean, round(quantile_cont(value, 0.95) FILTER (event_id > f), 6) AS p95, count(*) AS recompute_count, round(avg(value), 6) AS ari, round(stddev_pop(value), 6) AS nmi FROM events JOIN t USING (event_type) GROUP BY method),
b AS (SELECT * FROM s WHERE method = 'full_hdbscan')"""
_ROLE_SQL = "CASE s.method " + " ".join(f"WHEN '{m}' THEN '{r}'" for m, r in reports.ROLES.items()) + " ELSE 'candidate' END"


def _event_summaries(spark, sf):
    e = _t(spark, sf, "events")
    types = sorted(r[0] for r in e.select("event_type").distinct().collect())
    named = e.withColumn("method", F.create_map(*[F.lit(x) for kv in zip(types, _NAMES) for x in kv])[F.col("event_type")])
    times = reports.latency(named, "method", "value", "event_id").select("method", F.col("steady_mean").alias("steady_mean_step_ms"), F.col("steady_p95").alias("steady_p95_step_ms"))
    rows = named.groupBy("method").agg(F.count("*").alias("recompute_count"), F.round(F.avg("value"), 6).alias("ari"), F.round(F.stddev_pop("value"), 6).alias("nmi"))
    return rows.join(times, "method").withColumn("status", F.when(F.col("method") == "diart_style", "failed").otherwise("ok"))


@query(f"""WITH {_STEPS} SELECT s.method, {_ROLE_SQL} AS role, s.status, s.mean AS steady_mean_step_ms, b.mean AS full_steady_mean_step_ms, round(CASE WHEN s.status = 'ok' AND s.mean > 0 THEN b.mean / s.mean ELSE 0 END, 6) AS speedup_vs_full,
s.p95 AS steady_p95_step_ms, b.p95 AS full_steady_p95_step_ms, s.recompute_count, s.ari, s.nmi, round(s.ari - b.ari, 6) AS delta_ari, round(s.nmi - b.nmi, 6) AS delta_nmi FROM s, b""", False)
def compare_to_full(spark, sf):
    s = _event_summaries(spark, sf)
    out = reports.compare_to_full(s, s, ["ari", "nmi"], ["recompute_count"])
    return out.withColumns({c: F.round(c, 6) for c in ("speedup_vs_full", "delta_ari", "delta_nmi")})


@query("SELECT user_id % 20 AS seed, " + ", ".join(f"round(avg(value) FILTER (event_type = t[{i + 1}]), 6) AS {m}_ari, count(*) FILTER (event_type = t[{i + 1}]) AS {m}_n" for i, m in enumerate(_NAMES[:3])) + " FROM events, (SELECT list(DISTINCT event_type ORDER BY event_type) AS t FROM events) GROUP BY seed", False)
def seed_lookup(spark, sf):
    """Three methods side by side by seed."""
    e = _t(spark, sf, "events")
    types = sorted(r[0] for r in e.select("event_type").distinct().collect())[:3]
    named = e.where(F.col("event_type").isin(types)).withColumn("method", F.create_map(*[F.lit(x) for kv in zip(types, _NAMES) for x in kv])[F.col("event_type")])
    rows = named.groupBy((F.col("user_id") % 20).alias("seed"), "method").agg(F.round(F.avg("value"), 6).alias("ari"), F.count("*").alias("n"))
    out = reports.lookup(rows, "seed", _NAMES[:3], ["ari", "n"])
    return out.withColumns({f"{m}_n": F.coalesce(f"{m}_n", F.lit(0)) for m in _NAMES[:3]})


@query("SELECT event_type, " + ", ".join(f"round(avg(value) FILTER (user_id % 4 = {i}), 6) AS \"{i}\"" for i in range(4)) + " FROM events GROUP BY event_type", False)
def sensitivity_matrix(spark, sf):
    rows = _t(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 4).alias("interval")).agg(F.round(F.avg("value"), 6).alias("ari"))
    return reports.sensitivity(rows, "event_type", "interval", "ari")


@query("SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS min, max(value) AS max FROM events", False)
def value_extremes(spark, sf):
    return reports.extremes(_t(spark, sf, "events"), "value")


@query("SELECT event_type, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std FROM events GROUP BY event_type", False)
def multiseed_summary(spark, sf):
    return reports.by_method(_t(spark, sf, "events"), ["value"], "event_type")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value) FILTER (event_id > f), 6) AS steady_mean, round(quantile_cont(value, 0.95) FILTER (event_id > f), 6) AS steady_p95 FROM events JOIN (SELECT event_type, min(event_id) AS f FROM events GROUP BY event_type) USING (event_type) GROUP BY event_type", False)
def latency_percentiles(spark, sf):
    return reports.latency(_t(spark, sf, "events"), "event_type", "value", "event_id")


@query("SELECT conv_id, turn, total, longest FROM (SELECT conv_id, turn, (sum(length(text)) OVER w)::BIGINT AS total, max(length(text)) OVER w AS longest, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE k % 3 = 0 OR k = n", False)
def checkpoint_rows(spark, sf):
    from pyspark.sql import Window

    c = _t(spark, sf, "conversations")
    w, run = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    size = F.length("text")
    out = c.select("conv_id", "turn", F.sum(size).over(run).alias("total"), F.max(size).over(run).alias("longest"), F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))
    return out.where("k % 3 = 0 or k = n").select("conv_id", "turn", "total", "longest")


def _clusters(backend):
    def run(spark, sf):
        return density.cluster_streams(_points(spark, sf), backend).select("seq", "label", "pred")

    run.__name__ = f"{backend}_labels"
    return run


for _b in density.BACKENDS:
    query()(_clusters(_b))


#: Online assignment step by step: centroids, their sizes, the arrival's cluster and the distances so far.
_ONLINE = f"""{POINTS}, p AS MATERIALIZED (SELECT 's' || (seq // {streams.SESSION}) AS sid, seq, label, e, row_number() OVER (PARTITION BY seq // {streams.SESSION} ORDER BY seq) AS k FROM points),
f AS (SELECT sid, k, [e] AS c, [1] AS n, 0::BIGINT AS pred, 0::BIGINT AS cmp FROM p WHERE k = 1 UNION ALL
SELECT sid, k, CASE WHEN near THEN list_concat(list_append(c[1:i - 1], list_transform(moved, lambda x: x / greatest(sqrt(list_dot_product(moved, moved)), 1e-12))), c[i + 1:]) ELSE list_append(c, e) END,
CASE WHEN near THEN list_concat(list_append(n[1:i - 1], n[i] + 1), n[i + 1:]) ELSE list_append(n, 1) END, CASE WHEN near THEN i - 1 ELSE len(c) END, cmp + len(c)
FROM (SELECT *, d[i] <= 0.7 AS near, list_transform(c[i], lambda x, j: (x * n[i] + e[j]) / (n[i] + 1)) AS moved FROM (SELECT *, list_position(d, list_min(d)) AS i
FROM (SELECT f.sid, p.k, f.c, f.n, f.cmp, p.e, list_transform(f.c, lambda x: 1 - list_dot_product(x, p.e)) AS d FROM f JOIN p ON p.sid = f.sid AND p.k = f.k + 1)))),
placed AS MATERIALIZED (SELECT p.sid AS stream_id, p.seq, p.label, f.pred, f.cmp, p.k FROM f JOIN p ON p.sid = f.sid AND p.k = f.k)"""

_ONLINE_LABELS = f"WITH RECURSIVE {_ONLINE} SELECT stream_id, seq, label, pred, 0::BIGINT AS recompute_count, max(cmp) OVER w AS distance_comparisons, count(*) OVER w AS cheap_update_count, 0::BIGINT AS uncertainty_count FROM placed WINDOW w AS (PARTITION BY stream_id)"


def _method(name):
    def run(spark, sf):
        """The last labels of each stream, and the counters; nothing is evaluated on the way."""
        rows = methods.replay(_points(spark, sf), [name], methods.Config(checkpoint=1 << 30))
        return rows.select("stream_id", "seq", "label", "pred", "recompute_count", "distance_comparisons", "cheap_update_count", "uncertainty_count")

    run.__name__ = f"method_{name}"
    return run


for _m in methods.METHODS:
    query(_ONLINE_LABELS if _m == "diart_style" else None, False)(_method(_m))


@query(f"""WITH RECURSIVE {_ONLINE}, c AS (SELECT stream_id, label, pred, count(*) AS n FROM placed GROUP BY ALL), t AS (SELECT stream_id, label, sum(n) AS a FROM c GROUP BY ALL), q AS (SELECT stream_id, pred, sum(n) AS b FROM c GROUP BY ALL),
x AS (SELECT stream_id, sum(n)::DOUBLE AS n, sum(n * (n - 1) / 2) AS tp FROM c GROUP BY stream_id), y AS (SELECT stream_id, sum(a * (a - 1) / 2) AS same, -sum(a / n * ln(a / n)) AS hu FROM t JOIN x USING (stream_id) GROUP BY stream_id),
z AS (SELECT stream_id, sum(b * (b - 1) / 2) AS merged, -sum(b / n * ln(b / n)) AS hv, count(*) AS cluster_count FROM q JOIN x USING (stream_id) GROUP BY stream_id),
i AS (SELECT stream_id, sum(c.n / x.n * ln(c.n * x.n / (a::DOUBLE * b))) AS mi FROM c JOIN t USING (stream_id, label) JOIN q USING (stream_id, pred) JOIN x USING (stream_id) GROUP BY stream_id)
SELECT stream_id, round(tp / greatest(1, merged), 9) AS pairwise_precision, round(tp / greatest(1, same), 9) AS pairwise_recall, round((merged - tp) / (n * (n - 1) / 2 - same), 9) AS false_merge_rate, 1.0::DOUBLE AS coverage,
round((tp - same * merged / (n * (n - 1) / 2)) / ((same + merged) / 2 - same * merged / (n * (n - 1) / 2)), 9) AS ari, round(greatest(0, mi) / ((hu + hv) / 2), 9) AS nmi, cluster_count FROM x JOIN y USING (stream_id) JOIN z USING (stream_id) JOIN i USING (stream_id)""", False)
def online_assign_quality(spark, sf):
    """The flagship: normalise, assign online in arrival order, contingency, quality of each stream."""
    rows = methods.replay(_points(spark, sf), ["diart_style"], methods.Config(checkpoint=1 << 30))
    return metrics.quality(rows, ("stream_id",))


_RUN = ["window_hdbscan", "fishdbc", "approx_predict", "diart_style"]


@query(f"""WITH RECURSIVE {_ONLINE}, r AS (SELECT stream_id, count(*) AS n, max(cmp) AS cmp FROM placed GROUP BY stream_id), k AS (SELECT stream_id, avg(k) AS held, avg(least(k, 100)) AS windowed FROM placed JOIN r USING (stream_id) WHERE k % 10 = 0 OR k = n GROUP BY stream_id),
m AS (SELECT unnest([{", ".join(f"'{m}'" for m in _RUN)}]) AS method),
s AS (SELECT stream_id, method, n, CASE method WHEN 'approx_predict' THEN (n >= 20)::BIGINT WHEN 'diart_style' THEN 0 ELSE n END AS recompute_count, CASE method WHEN 'approx_predict' THEN greatest(0, n - 20) ELSE 0 END AS prediction_count,
CASE method WHEN 'fishdbc' THEN greatest(0, n * (n + 1) // 2 - 6) WHEN 'diart_style' THEN cmp ELSE 0 END AS d, CASE method WHEN 'diart_style' THEN n ELSE 0 END AS cheap, CASE method WHEN 'window_hdbscan' THEN windowed ELSE held END AS held, CASE method WHEN 'window_hdbscan' THEN least(n, 100) ELSE n END AS evaluated FROM r JOIN k USING (stream_id), m)
SELECT stream_id, method, 'ok' AS status, n AS n_input, recompute_count::BIGINT AS recompute_count, prediction_count::BIGINT AS prediction_count, d::BIGINT AS distance_comparisons, cheap::BIGINT AS cheap_update_count, cheap::BIGINT AS local_update_count, 0.0::DOUBLE AS full_trigger_rate, round(cheap / n, 9) AS cheap_update_rate,
round(d / n, 6) AS distance_comparisons_per_input, round(held, 6) AS checkpoint_mean_active_points, evaluated::BIGINT AS evaluation_points FROM s""", False)
def run_summary(spark, sf):
    """The summaries' deterministic part."""
    rows = harness.run(_points(spark, sf), _RUN)
    counts = ["recompute_count", "prediction_count", "distance_comparisons", "cheap_update_count", "local_update_count"]
    rates = [("full_trigger_rate", 9), ("cheap_update_rate", 9), ("distance_comparisons_per_input", 6), ("checkpoint_mean_active_points", 6)]
    return rows.select("stream_id", "method", "status", "n_input", *counts, *[F.round(c, n).alias(c) for c, n in rates], "evaluation_points")


@query()
def run_trace(spark, sf):
    return harness.trace(_points(spark, sf), ["adaptive_fishdbc", "diart_style"], methods.Config(checkpoint=100)).drop("max_pending", "max_queue_depth")


@query()
def rate_sweep(spark, sf):
    chosen, config = harness.preset("async")
    return harness.rate_sweep(_points(spark, sf), [1, 5, 10, 20], chosen, config).drop("decision_mean_ms", "decision_p95_ms", "maintenance_ms_total", "maintenance_ms_max")


@query()
def multiseed_run(spark, sf):
    """The table's streams in the orders of five seeds."""
    seeds = harness.reordered(_points(spark, sf), [20260910 + i for i in range(5)])
    return harness.multi_seed(seeds, ["diart_style", "window_hdbscan"])[1].select("method", "ari_mean", "ari_std", "nmi_mean", "nmi_std", "cluster_accuracy_noise_singletons_mean", "false_merge_rate_mean")


#: Prim's rule over the matrix of mutual reachability, the least edge by (weight, points) first.
_PRIM = """p AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS i, seq, e FROM points),
d AS MATERIALIZED (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN NULL ELSE round(1 - greatest(-1, least(1, list_dot_product(a.e, b.e))), 9) END AS d FROM p a, p b),
c AS MATERIALIZED (SELECT i, d AS core FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM d WHERE d IS NOT NULL) WHERE r = 2),
m AS MATERIALIZED (SELECT d.i, list(greatest(d, x.core, y.core) ORDER BY j) AS w FROM d JOIN c x ON x.i = d.i JOIN c y ON y.i = d.j GROUP BY d.i),
t AS (SELECT 1 AS k, NULL::STRUCT(w DOUBLE, a BIGINT, b BIGINT, v BIGINT) AS e, list_transform(w, lambda x, j: CASE WHEN j = 1 THEN NULL ELSE {'w': x, 'a': 1::BIGINT, 'b': j::BIGINT, 'v': j::BIGINT} END) AS near FROM m WHERE i = 1 UNION ALL
SELECT k + 1, pick, list_transform(near, lambda x, j: CASE WHEN x IS NULL OR j = pick.v THEN NULL WHEN x <= {'w': w[j], 'a': least(j, pick.v)::BIGINT, 'b': greatest(j, pick.v)::BIGINT, 'v': j::BIGINT} THEN x ELSE {'w': w[j], 'a': least(j, pick.v)::BIGINT, 'b': greatest(j, pick.v)::BIGINT, 'v': j::BIGINT} END)
FROM (SELECT k, near, list_sort(list_filter(near, lambda x: x IS NOT NULL))[1] AS pick FROM t WHERE k < (SELECT count(*) FROM p)) JOIN m ON m.i = pick.v)"""


@query(f", {_PRIM} SELECT x.seq AS a, y.seq AS b, round(t.e.w, 6) AS w FROM t JOIN p x ON x.i = t.e.a JOIN p y ON y.i = t.e.b")
def spanning_tree(spark, sf):
    """The minimum spanning tree of all vectors under mutual reachability."""
    return hierarchy.spanning_tree(_points(spark, sf), 2).select("a", "b", F.round("w", 6).alias("w"))


@query()
def hdbscan_large(spark, sf):
    """All vectors as one set, clustered by density as a dataflow: pred is the least seq of the cluster, -1 noise."""
    return hierarchy.cluster(_points(spark, sf)).join(_points(spark, sf).select("seq", "label"), "seq").select("seq", "label", "pred")


@query()
def ahc_large(spark, sf):
    """All vectors as one set by average linkage at distance 0.70: pred is the least seq of the cluster."""
    return linkage.average_linkage(_points(spark, sf)).join(_points(spark, sf).select("seq", "label"), "seq").select("seq", "label", "pred")


@query()
def spectral_large(spark, sf):
    """All vectors as one set by the leading eigenvectors of the graph of 50 neighbours: pred is the least seq of the cluster."""
    return spectral.cluster(_points(spark, sf)).join(_points(spark, sf).select("seq", "label"), "seq").select("seq", "label", "pred")


@query()
def approximate_neighbours(spark, sf):
    """The five nearest that share a bucket."""
    near = approximate.nearest(_points(spark, sf), 5)
    return near.select("i", F.posexplode("near").alias("r", "x")).select("i", (F.col("r") + 1).alias("r"), "x.j", F.round("x.distance", 6).alias("distance"))


@query(f""", w AS MATERIALIZED (SELECT seq, label, e, seq // {streams.SESSION} AS s, row_number() OVER (PARTITION BY seq // {streams.SESSION} ORDER BY seq) AS k, count(*) OVER (PARTITION BY seq // {streams.SESSION}) AS n FROM points),
m AS MATERIALIZED (SELECT s, seq, label, e FROM w WHERE k <= 20 AND n >= 20),
md AS MATERIALIZED (SELECT s, a.seq AS i, b.seq AS j, a.label AS li, b.label AS lj, round(list_distance(a.e, b.e), 9) AS d FROM m a JOIN m b USING (s)),
core AS MATERIALIZED (SELECT i, list_sort(list(d))[3] AS c FROM md GROUP BY i),
lim AS (SELECT s, li AS label, min(greatest(d, x.c, y.c)) AS r FROM md JOIN core x USING (i) JOIN core y ON y.i = md.j WHERE li <> lj GROUP BY s, li),
sc AS MATERIALIZED (SELECT w.s, w.seq, m.seq AS j, m.label AS lm, c, round(list_distance(w.e, m.e), 9) AS d FROM w JOIN m USING (s) JOIN core ON i = m.seq WHERE w.k > 20),
own AS (SELECT seq, list_sort(list(d))[2] AS o FROM sc GROUP BY seq),
pick AS (SELECT s, seq, lm, reach FROM (SELECT s, seq, lm, greatest(d, c, o) AS reach, row_number() OVER (PARTITION BY seq ORDER BY greatest(d, c, o), j) AS q FROM sc JOIN own USING (seq)) WHERE q = 1)
SELECT 's' || w.s AS stream_id, w.seq, w.label, CASE WHEN n < 20 THEN -1 WHEN k <= 20 THEN w.label WHEN reach <= coalesce(r, 'inf'::DOUBLE) THEN lm ELSE -1 END AS pred, round(reach, 6) AS reach
FROM w LEFT JOIN pick USING (seq) LEFT JOIN lim ON lim.s = pick.s AND lim.label = lm""")
def frozen_predict(spark, sf):
    """Every stream's first 20 points with the table's labels are its model; the rest is scored against it."""
    p = _points(spark, sf)
    models = Store(spark)(frozen.model(frozen.warm(p), "label"))
    return frozen.predict(p, models).join(p.select("seq", "label"), "seq").select("stream_id", "seq", "label", "pred", F.round("reach", 6).alias("reach"))


@query()
def frozen_hdbscan_labels(spark, sf):
    """The same, the warm-up clustered by density."""
    p = _points(spark, sf)
    return frozen.predict(p, Store(spark)(frozen.fit(p))).select("stream_id", "seq", "pred")


@query()
def prefix_quality(spark, sf):
    """Quality at each 50th arrival and at the last, every prefix clustered afresh by density."""
    return prefixes.quality(prefixes.refit(_points(spark, sf), "hdbscan", 50))


@query(f"""WITH r AS (SELECT 's' || (vec_id // {streams.SESSION}) AS stream_id, count(*) AS n FROM embeddings GROUP BY 1), c AS (SELECT stream_id, least(n, 50 * unnest(range(1, ceil(n / 50)::BIGINT + 1))) AS u FROM r)
SELECT stream_id, count(*) AS recompute_count, sum(u)::BIGINT AS fitted_points, sum(u * (u - 1) // 2)::BIGINT AS distance_comparisons FROM c GROUP BY stream_id""", False)
def prefix_work(spark, sf):
    """The fits that ran for full prefixes by average linkage at each 50th arrival."""
    return prefixes.work(prefixes.refit(_points(spark, sf), "ahc", 50))


@query()
def compressed_streams(spark, sf):
    """Streams of 500 points fused down to 495, clustered by density before each fusion."""
    out = fusion.compress(_points(spark, sf), streams.SESSION - 5)
    return out.select("stream_id", "seq", F.array_join("members", ",").alias("members"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))
