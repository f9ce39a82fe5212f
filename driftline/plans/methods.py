"""The twelve streaming methods as folds over one stream's arrivals.

A method sees arrivals in order and keeps its state; batch replay and the streaming
query share these classes.  Methods that only refit are evaluated where their labels
are read (checkpoints), since a refit depends on the prefix alone; counters are those of
a method that refits at once.
"""

import dataclasses
import time
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import density as D


@dataclasses.dataclass(frozen=True)
class Config:
    cap: int = 100
    warmup: int = 20
    tradeoff_warmup: int = 12
    margin: float = 0.02
    max_distance: float = 0.70
    full_interval: int = 4
    batch_size: int = 3
    max_queue: int = 8
    commit_lag: int = 0
    repair: bool = True
    least: int = 4
    k: int = 2
    checkpoint: int = 10

    def __post_init__(self):
        if self.margin <= 0 or self.cap <= 0 or self.batch_size <= 0 or self.checkpoint <= 0 or self.max_queue <= 0:
            raise ValueError("margin, cap, batch size, queue and checkpoint must be positive")


def unit(v):
    return v / max(np.linalg.norm(v), 1e-12)


class Reps:
    """Sums and counts of clusters; nearest and runner-up."""

    def __init__(self, x=None, labels=None):
        self.sum, self.n = {}, {}
        for v, l in zip(x if x is not None else [], labels if labels is not None else []):
            if l >= 0:
                self.add(int(l), v)

    def add(self, label, v):
        self.sum[label] = self.sum.get(label, 0) + v.astype(float)
        self.n[label] = self.n.get(label, 0) + 1

    def names(self):
        return sorted(self.sum)

    def gate(self, v, c: Config):
        """(label, confident)"""
        names = self.names()
        if not names:
            return -1, False
        reps = np.array([unit(self.sum[l] / self.n[l]) for l in names], np.float32)
        d = 1 - np.clip(reps @ v, -1, 1)
        order = np.argsort(d, kind="stable")
        second = d[order[1]] if len(order) > 1 else np.inf
        return names[order[0]], bool(d[order[0]] <= c.max_distance and second - d[order[0]] >= c.margin)


#: Labels that the runs over one stream keep for each other.
MEMO = 1 << 23


class Method:
    counters = ("recompute_count", "prediction_count", "distance_comparisons", "cheap_update_count", "full_trigger_count", "uncertainty_count", "local_update_count", "fallback_full_count", "backpressure_count", "incremental_cluster_count", "risk_flush_count")
    #: Whether an arrival's own time is maintenance; else maintenance keeps its own clock.
    foreground_is_maintenance = True
    #: Whether what is held is the arrivals themselves, so that a fit depends on their number alone.
    whole = True

    def __init__(self, config: Config):
        self.c, self.x, self.labels = config, [], []
        self.memo, self.saved = None, 0.0
        self.count = dict.fromkeys(self.counters, 0)
        self.max_pending = self.max_queue_depth = 0
        self.maintenance: list[float] = []

    def data(self):
        return np.array(self.x, np.float32)

    def once(self, of, make):
        """make(), or what another run over the same arrivals has made of as many of them; `saved` are the seconds that it took there."""
        if self.memo is None or not self.whole:
            return make()
        key = (of, len(self.x))
        if key not in self.memo:
            began = time.perf_counter()
            out = make()
            if (len(self.memo) + 1) * len(self.x) <= MEMO:
                self.memo[key] = out, time.perf_counter() - began
            return out
        self.saved += self.memo[key][1]
        return self.memo[key][0]

    def fit(self, backend):
        return self.once(backend, lambda: D.cluster(self.data(), backend, self.c.least, self.c.k))

    def evaluation(self):
        """(seq, label) of what counts."""
        return list(range(len(self.x))), list(self.labels)

    def finish(self):
        pass


class Refit(Method):
    """Full-prefix refit on each arrival."""

    def __init__(self, config, backend, action, counted=True, triggers=False):
        super().__init__(config)
        self.backend, self.action, self.counted, self.triggers = backend, action, counted, triggers

    def update(self, v):
        self.x.append(v)
        n = len(self.x)
        self.count["recompute_count"] += 1
        self.count["full_trigger_count"] += self.triggers
        self.count["distance_comparisons"] += n * (n - 1) // 2 if self.counted else 0
        return self.action

    def evaluation(self):
        return list(range(len(self.x))), self.fit(self.backend).tolist()


class Window(Method):
    """Refit on the last `cap` arrivals, of which alone the quality is judged."""

    def update(self, v):
        self.x.append(v)
        self.count["recompute_count"] += 1
        return "window_recluster"

    def evaluation(self):
        x = self.data()[-self.c.cap :]
        return list(range(len(self.x) - len(x), len(self.x))), D.cluster(x, "hdbscan", self.c.least, self.c.k).tolist()


class Incremental(Method):
    """Extraction from the mutual-reachability tree on each arrival."""

    def update(self, v):
        self.x.append(v)
        self.count["recompute_count"] += 1
        if len(self.x) >= max(2, self.c.least):
            self.count["distance_comparisons"] += len(self.x)
        return "incremental_mst_cluster"

    def evaluation(self):
        return list(range(len(self.x))), self.fit("fishdbc").tolist()


class Observed(Method):
    """As Incremental; the gate only watches the structure, it never replaces a decision of the tree."""

    name = "adaptive_fishdbc"

    def update(self, v):
        self.x.append(v)
        self.labels = self.fit("fishdbc").tolist()
        self.count["recompute_count"] += 1
        self.count["incremental_cluster_count"] += len(self.x) >= max(2, self.c.least)
        reps = Reps(self.x, self.labels)
        if len(self.x) <= self.c.tradeoff_warmup or not reps.sum:
            return f"{self.name}_mst_update"
        self.count["distance_comparisons"] += len(reps.sum)
        if reps.gate(v, self.c)[1]:
            return f"{self.name}_confident_mst"
        self.count["uncertainty_count"] += 1
        return f"{self.name}_risk_observed"


class Tradeoff(Method):
    def update(self, v):
        self.x.append(v)
        n = len(self.x)
        if n < self.c.tradeoff_warmup:
            self.labels.append(-1)
            return "tradeoff_warmup"
        if n == self.c.tradeoff_warmup:
            self.refit()
            return "tradeoff_initial_full"
        self.count["distance_comparisons"] += len(self.reps.sum)
        label, sure = self.reps.gate(v, self.c)
        if sure:
            self.labels.append(label)
            self.reps.add(label, v)
            self.count["cheap_update_count"] += 1
            self.count["local_update_count"] += 1
            self.since += 1
            if not self.c.full_interval or self.since < self.c.full_interval:
                return "tradeoff_cached_assign"
        elif self.reps.sum:
            self.count["uncertainty_count"] += 1
        self.refit()
        return "tradeoff_uncertainty_full"

    def refit(self):
        self.labels = self.fit("hdbscan").tolist()
        self.reps, self.since = Reps(self.x, self.labels), 0
        self.count["recompute_count"] += 1
        self.count["full_trigger_count"] += 1


class Batched(Method):
    """Gate against representatives of the last flush; an unsure arrival flushes."""

    name = "adaptive_fishdbc_batch"

    def __init__(self, config):
        super().__init__(config)
        self.reps, self.pending = Reps(), 0

    def flush(self):
        self.labels = self.fit("fishdbc").tolist()
        self.reps, self.pending = Reps(self.x, self.labels), 0
        self.count["recompute_count"] += 1
        self.count["incremental_cluster_count"] += 1

    def update(self, v):
        self.x.append(v)
        self.labels.append(-1)
        self.pending += 1
        n = len(self.x)
        if n < self.c.tradeoff_warmup:
            return f"{self.name}_warmup"
        if n == self.c.tradeoff_warmup:
            self.flush()
            return f"{self.name}_initial_refresh"
        self.count["distance_comparisons"] += len(self.reps.sum)
        label, sure = self.reps.gate(v, self.c)
        if sure:
            self.labels[-1] = label
            self.count["cheap_update_count"] += 1
            self.count["local_update_count"] += 1
            self.max_pending = max(self.max_pending, self.pending)
            if self.pending < self.c.batch_size:
                return f"{self.name}_buffer"
            self.flush()
            return f"{self.name}_flush"
        self.count["uncertainty_count"] += 1
        self.flush()
        return f"{self.name}_risk_flush"

    def finish(self):
        if self.pending:
            self.flush()


class Deferred(Method):
    """The flagship: the gate answers at once, a queue feeds the maintenance that commits whole labellings.

    Time is virtual: a commit becomes visible `commit_lag` arrivals after its flush; the queue is
    bounded, and an arrival that finds it full waits for the oldest commit.
    """

    name = "adaptive_fishdbc_async"
    foreground_is_maintenance = False

    def __init__(self, config):
        super().__init__(config)
        self.reps, self.queue, self.held, self.pending, self.synced, self.commits = Reps(), 0, 0, 0, 0, []

    def commit(self):
        """Maintenance of all that is queued."""
        began, saved = time.perf_counter(), self.saved
        labels = self.fit("fishdbc")
        if self.c.repair:
            labels = self.once("repair", lambda: repair(self.data(), labels))
        self.count["recompute_count"] += 1
        self.count["incremental_cluster_count"] += 1
        self.maintenance.append((time.perf_counter() - began + self.saved - saved) * 1000)
        self.commits.append((len(self.x) + self.c.commit_lag, labels.tolist()))
        self.held = 0

    def sync(self, all_=False):
        while self.commits and (all_ or self.commits[0][0] <= len(self.x)):
            labels = self.commits.pop(0)[1]
            if len(labels) > self.synced:
                self.synced = len(labels)
                self.labels = labels + [-1] * (len(self.x) - len(labels))
                self.reps = Reps(self.x, self.labels)

    def update(self, v):
        self.sync()
        self.x.append(v)
        self.labels.append(-1)
        n, force = len(self.x), False
        if n <= self.c.tradeoff_warmup:
            action, force = "warmup", n == self.c.tradeoff_warmup
        else:
            self.count["distance_comparisons"] += len(self.reps.sum)
            label, sure = self.reps.gate(v, self.c)
            if sure:
                self.labels[-1] = label
                self.count["cheap_update_count"] += 1
                self.count["local_update_count"] += 1
                self.pending += 1
                force = self.pending >= self.c.batch_size
                action = "buffer"
            else:
                self.count["uncertainty_count"] += 1
                self.count["risk_flush_count"] += 1
                action, force = "risk_flush", True
            if force:
                self.pending = 0
        self.held += 1
        self.max_pending = max(self.max_pending, self.held)
        self.max_queue_depth = max(self.max_queue_depth, min(self.held, self.c.max_queue))
        if len(self.commits) >= self.c.max_queue:
            self.count["backpressure_count"] += 1
            self.commits[0] = (n, self.commits[0][1])
        if force or self.held >= self.c.batch_size:
            self.commit()
        return f"{self.name}_{action}"

    def finish(self):
        if self.held:
            self.commit()
        self.sync(True)


def repair(x, labels):
    """Much noise: all points by average linkage at the same number of clusters; little: only noise near a clean cluster comes back."""
    names = np.unique(labels[labels >= 0])
    if len(x) < 100 or len(names) < 2 or not (labels < 0).any():
        return labels
    if (labels < 0).mean() >= 0.25:
        return D.average_linkage(x, None, len(names))
    clean = labels >= 0
    out = labels.copy()
    out[clean] = D.average_linkage(x[clean], None, len(names))
    reps = np.array([unit(x[out == l].astype(float).mean(0)) for l in range(len(names))])
    far = np.array([np.percentile(1 - np.clip(x[out == l] @ reps[l], -1, 1), 95) for l in range(len(names))])
    d = 1 - np.clip(x[~clean] @ reps.T, -1, 1)
    near = d.argmin(1)
    out[~clean] = np.where(d[np.arange(len(near)), near] <= 1.5 * far[near], near, -1)
    return out


class Compressed(Method):
    """Above `cap` the most similar pair of one label is fused, and so on; fused rows count for all their points."""

    whole = False

    def __init__(self, config):
        super().__init__(config)
        self.members = []

    def update(self, v):
        self.x.append(v)
        self.members.append([sum(map(len, self.members))])
        self.labels = self.fit("hdbscan").tolist()
        self.count["recompute_count"] += 1
        action = "compressed_recluster"
        while len(self.x) > self.c.cap:
            x, l = self.data(), np.array(self.labels)
            s = np.where((l[:, None] == l) & (l >= 0) & np.triu(np.ones((len(l), len(l)), bool), 1), x @ x.T, -np.inf)
            if not np.isfinite(s).any():
                return "compression_skipped_no_qualified_pair"
            top = s.max()
            at = [(l[i], i, j) for i, j in zip(*np.nonzero(s == top))]
            _, i, j = min(at)
            fused, held = unit(self.x[i] + self.x[j]).astype(np.float32), self.members[i] + self.members[j]
            self.x = [r for k, r in enumerate(self.x) if k not in (i, j)] + [fused]
            self.members = [r for k, r in enumerate(self.members) if k not in (i, j)] + [held]
            self.labels = self.fit("hdbscan").tolist()
            action = "fused_recluster"
        return action

    def evaluation(self):
        pairs = sorted((m, l) for ms, l in zip(self.members, self.labels) for m in ms)
        return [m for m, _ in pairs], [l for _, l in pairs]


class Predict(Method):
    """Fits once at the end of warm-up; later arrivals go to the cluster of their nearest point by mutual reachability if their density is within the cluster's."""

    def update(self, v):
        if len(self.x) >= self.c.warmup and self.count["recompute_count"]:
            self.count["prediction_count"] += 1
            d = np.sqrt(np.maximum(0, ((self.base - v) ** 2).sum(1)))
            core = np.partition(d, self.c.k - 1)[self.c.k - 1]
            reach = np.maximum(np.maximum(d, self.core), core)
            i = int(reach.argmin())
            label = int(self.fitted[i])
            self.labels.append(label if label >= 0 and reach[i] <= self.reach.get(label, -1) else -1)
            self.x.append(v)
            return "approx_predict"
        self.x.append(v)
        self.labels.append(-1)
        if len(self.x) == self.c.warmup:
            self.base = self.data()
            self.fitted = self.fit("hdbscan")
            self.labels = self.fitted.tolist()
            d = D.distances(self.base, "euclidean")
            k = min(self.c.k, len(d) - 1)
            self.core = np.partition(d, k, axis=1)[:, k]
            inside = lambda l: np.maximum(np.maximum(self.core[:, None], self.core), d)[np.ix_(self.fitted == l, self.fitted != l)]
            self.reach = {int(l): float(inside(l).min()) if (self.fitted != l).any() else np.inf for l in np.unique(self.fitted) if l >= 0}
            self.count["recompute_count"] += 1
        return "approx_predict"


class Online(Method):
    """Nearest centroid within the distance, else a new cluster; distances aren't clipped."""

    def __init__(self, config):
        super().__init__(config)
        self.centroids, self.n, self.seen = [], [], 0

    def update(self, v):
        self.seen += 1
        self.labels.append(self.place(v))
        self.count["cheap_update_count"] += 1
        self.count["local_update_count"] += 1
        return "diart_style_online_assign"

    def evaluation(self):
        return list(range(self.seen - len(self.labels), self.seen)), list(self.labels)

    def place(self, v):
        v = np.asarray(v, float)
        self.count["distance_comparisons"] += len(self.centroids)
        if self.centroids:
            d = 1 - np.array(self.centroids) @ v
            i = int(d.argmin())
            if d[i] <= self.c.max_distance:
                self.centroids[i] = unit((self.centroids[i] * self.n[i] + v) / (self.n[i] + 1))
                self.n[i] += 1
                return i
        self.centroids.append(v)
        self.n.append(1)
        return len(self.n) - 1


METHODS = {
    "full_hdbscan": lambda c: Refit(c, "hdbscan", "full_recluster", triggers=True),
    "adaptive_tradeoff": Tradeoff,
    "adaptive_fishdbc": Batched,
    "adaptive_fishdbc_async": Deferred,
    "compressed_hdbscan": Compressed,
    "window_hdbscan": Window,
    "fishdbc": Incremental,
    "approx_predict": Predict,
    "fast_hdbscan": lambda c: Refit(c, "fast_hdbscan", "fast_full_recluster", False),
    "ahc": lambda c: Refit(c, "ahc", "ahc_full_recluster"),
    "sc_pna": lambda c: Refit(c, "sc_pna", "sc_pna_full_recluster"),
    "diart_style": Online,
}
#: Methods that no run asks for by default.
MORE_METHODS = {"adaptive_fishdbc_observed": Observed}


def method(name: str, config: Config) -> Method:
    return (METHODS | MORE_METHODS)[name](config)

TRACE = "stream_id string, method string, step int, action string, seq long, label long, pred long, " + ", ".join(f"{c} long" for c in Method.counters) + ", max_pending int, max_queue_depth int, last boolean"


def dealt(points: DataFrame, methods: list[str]) -> DataFrame:
    """The arrivals once for each method, in as many tasks as the session has shuffle partitions: streams are few bytes and long work, so partitions must not be put together by their bytes."""
    tagged = points.select("stream_id", "seq", "embedding", "label").withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    return tagged.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stream_id", "method")


def replay(points: DataFrame, methods: list[str], config: Config = Config()) -> DataFrame:
    """The checkpoint rows of each (stream, method): every `checkpoint`-th step and the last, exploded by evaluated point."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        m = method(pdf["method"].iloc[0], config)
        truth, seqs, out, n = pdf["label"].to_numpy(), pdf["seq"].to_numpy(), [], len(pdf)
        for step, v in enumerate(pdf["embedding"], 1):
            action = m.update(np.asarray(v, np.float32))
            if step == n:
                m.finish()
            if step % config.checkpoint == 0 or step == n:
                at, labels = m.evaluation()
                out.append(pd.DataFrame({"step": step, "action": action, "seq": seqs[at], "label": truth[at], "pred": labels, **m.count, "max_pending": m.max_pending, "max_queue_depth": m.max_queue_depth, "last": step == n}))
        out = pd.concat(out) if out else pd.DataFrame(columns=[])
        out.insert(0, "method", pdf["method"].iloc[0])
        out.insert(0, "stream_id", pdf["stream_id"].iloc[0])
        return out

    return dealt(points, methods).groupBy("stream_id", "method").applyInPandas(run, TRACE)


SUMMARY = (
    "stream_id string, method string, status string, error string, n_input long, wall_ms double, mean_step_ms double, p95_step_ms double, cold_start_steps_excluded int, steady_mean_step_ms double, steady_p95_step_ms double, "
    + ", ".join(f"{c} long" for c in Method.counters)
    + ", maintenance_ms_total double, maintenance_ms_max double, backpressure_ms_total double, max_pending int, max_queue_depth int, peak_python_mb double, "
    "checkpoint_mean_active_points double, full_trigger_rate double, cheap_update_rate double, distance_comparisons_per_input double, final array<struct<seq:long,label:long,pred:long>>"
)


def measured(points: DataFrame, methods: list[str], config: Config = Config(), memory: bool = False, lags: list[int] | None = None) -> DataFrame:
    """A row for each (stream, method): status, times of the arrivals, counters, rates and the final labels.

    Methods that only refit do so on every arrival here, since its time is what is measured.  A method that
    raises gives a row with status `failed` and the error, and the others go on.

    With `lags` there is a row for each of these values of `commit_lag`, in a column `lag`.  A stream's runs are one task then,
    and a fit of the same arrivals is made once: where it is taken again, the time that it took counts.
    """
    names = [c.split()[0] for c in SUMMARY.split("final ")[0].rstrip(", ").split(", ")] + ["final"]
    whole = {*Method.counters, "n_input", "cold_start_steps_excluded", "max_pending", "max_queue_depth"}

    def one(pdf: pd.DataFrame, name: str, config: Config, memo: dict | None) -> dict:
        truth, n = pdf["label"].to_numpy(), len(pdf)
        out = {"stream_id": pdf["stream_id"].iloc[0], "method": name, "n_input": n}
        began, steps, active = time.perf_counter(), [], []
        if memory:
            tracemalloc.start()
        try:
            m = method(name, config)
            m.memo = memo
            for step, v in enumerate(pdf["embedding"], 1):
                at, saved = time.perf_counter(), m.saved
                m.update(np.asarray(v, np.float32))
                if isinstance(m, (Refit, Window, Incremental)):
                    m.evaluation()
                steps.append((time.perf_counter() - at + m.saved - saved) * 1000)
                if step % config.checkpoint == 0 or step == n:
                    # the points that a method holds, which is fewer than it has seen where it drops or fuses some
                    active.append(min(step, config.cap) if isinstance(m, Window) else len(m.x) if m.x else step)
            m.finish()
            seqs = pdf["seq"].to_numpy()
            at, labels = m.evaluation()
            own = steps if m.foreground_is_maintenance else m.maintenance
            steady = steps[1:] if n > 1 else steps
            out |= {
                "status": "ok", "wall_ms": (time.perf_counter() - began + m.saved) * 1000, "mean_step_ms": np.mean(steps), "p95_step_ms": np.percentile(steps, 95), "cold_start_steps_excluded": int(n > 1),
                "steady_mean_step_ms": np.mean(steady), "steady_p95_step_ms": np.percentile(steady, 95), **m.count, "maintenance_ms_total": sum(own), "maintenance_ms_max": max(own, default=0.0), "backpressure_ms_total": 0.0,
                "max_pending": m.max_pending, "max_queue_depth": m.max_queue_depth, "checkpoint_mean_active_points": np.mean(active), "full_trigger_rate": m.count["full_trigger_count"] / n,
                "cheap_update_rate": m.count["cheap_update_count"] / n, "distance_comparisons_per_input": m.count["distance_comparisons"] / n,
                "final": [{"seq": int(seqs[i]), "label": int(truth[i]), "pred": int(p)} for i, p in zip(at, labels)],
            }
            if memory:
                out["peak_python_mb"] = tracemalloc.get_traced_memory()[1] / (1 << 20)
        except Exception as e:  # a failed method is a row, as its error
            out |= {"status": "failed", "error": f"{type(e).__name__}: {e}", "wall_ms": (time.perf_counter() - began) * 1000}
        finally:
            if memory:
                tracemalloc.stop()
        return out

    def table(rows: list[dict], names: list[str]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.array([r.get(c) for r in rows], "Int64") if c in whole else [r.get(c) for r in rows] for c in names})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return table([one(pdf, pdf["method"].iloc[0], config, None)], names)

    def run_lags(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, memo = pdf.sort_values("seq"), {}
        return table([{"lag": lag, **one(pdf, name, dataclasses.replace(config, commit_lag=lag), memo)} for name in methods for lag in lags], ["lag", *names])

    if lags is None:
        return dealt(points, methods).groupBy("stream_id", "method").applyInPandas(run, SUMMARY)
    each = points.select("stream_id", "seq", "embedding", "label").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "stream_id")
    return each.groupBy("stream_id").applyInPandas(run_lags, f"lag int, {SUMMARY}")
