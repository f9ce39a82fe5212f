"""Density clustering of any number of points as a dataflow: spanning tree, condensed tree, labels.

1. Each point's NEAR nearest others come from `scan.nearest`, and core distances with them.
2. Borůvka rounds over these lists: a component takes its least known edge where no point's list ends before
   it, since what lists leave out weighs no less than their ends; components are joined by pointer jumping,
   and edges are kept once for each pair of components.  Edges are ordered by (weight, points), so the tree is the only one.
3. Where no component can be sure, the points whose lists end too early get new lists, of the least edges to other components.
4. The tree's edges are dealt to levels of LEVEL edges by weight.  From the lightest level up, a
   level's merges make the hierarchy's nodes, and with them what the condensed tree needs of
   each: its size, and two sums from which the mass of a cluster follows when it ends in a
   split.  So excess of mass is decided on the way up.  From the heaviest level down, nodes pass the
   chosen cluster on to their parts, points at last.

A task holds one block of the scan or one level, whatever the number of points; the comparisons are n ** 2
by nature, the rest is of the order of n.

Distances are rounded to DIGITS so that ties are ties on every machine.  The root is no cluster; ids
(`seq`) are distinct and not negative.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .storage import Store

#: Decimal digits of distances, edges in a level, and neighbours in a list.
DIGITS = 9
LEVEL = 1 << 20
NEAR = 16


def distance_rows(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of x and y: clipped cosine, or Euclidean."""
    if metric == "cosine":
        d = 1 - np.clip(x @ y.T, -1, 1)
    else:
        d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T))
    return np.round(d, DIGITS)


def _jumped(up: DataFrame, store: Store) -> DataFrame:
    """p, r: where each ends along its links, by pointer jumping."""
    while True:
        jump = up.select(F.col("p").alias("r"), F.col("r").alias("r2"))
        nxt = store(up.join(jump, "r").select("p", F.col("r2").alias("r"), (F.col("r2") != F.col("r")).alias("moved")))
        up = nxt.select("p", "r")
        if nxt.where("moved").isEmpty():
            return up


def boruvka(edges: DataFrame, store: Store) -> DataFrame:
    """a, b, w: the minimum spanning forest of a graph, edges ordered by (w, a, b)."""
    spark, tree = edges.sparkSession, None
    left = store(edges.select(F.col("a").alias("p"), F.col("b").alias("q"), F.struct("w", "a", "b").alias("e")))
    while not left.isEmpty():
        both = left.select("p", "q", "e").union(left.select(F.col("q").alias("p"), F.col("p").alias("q"), "e"))
        best = store(both.groupBy("p").agg(F.min(F.struct("e", "q")).alias("m")).select("p", "m.q", "m.e"))
        taken = best.select("e.*").distinct()
        tree = taken if tree is None else tree.union(taken)
        # of two that chose each other the lesser is the root
        back = best.select(F.col("p").alias("q"), F.col("q").alias("p2"))
        up = store(best.join(back, "q").select("p", F.when((F.col("p2") == F.col("p")) & (F.col("p") < F.col("q")), F.col("p")).otherwise(F.col("q")).alias("r")))
        up = _jumped(up, store)
        low = up.select("p", F.col("r").alias("rp"))
        high = up.select(F.col("p").alias("q"), F.col("r").alias("rq"))
        joined = left.join(low, "p").join(high, "q").where("rp <> rq")
        left = store(joined.groupBy(F.least("rp", "rq").alias("p"), F.greatest("rp", "rq").alias("q")).agg(F.min("e").alias("e")))
    return tree.select("a", "b", "w") if tree is not None else spark.createDataFrame([], "a long, b long, w double")


def _edge(i: str, j: str, w: F.Column) -> F.Column:
    return F.struct(w.alias("w"), F.least(i, j).alias("a"), F.greatest(i, j).alias("b"))


def _contracted(edges: DataFrame) -> DataFrame:
    """p < q, e: the least edge of each pair of components."""
    return edges.groupBy(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).agg(F.min("e").alias("e"))


def _merged(left: DataFrame, ends: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(a, b, w of the edges taken; p, r: what each component has become) in one round of those that are sure."""
    best = left.union(left.select("q", "p", "e")).groupBy("p").agg(F.min(F.struct("e", "q")).alias("m")).select("p", "m.q", "m.e")
    now = store(ends.join(best, "p", "left").withColumn("sure", F.col("e").isNotNull() & (F.col("cut").isNull() | (F.col("e") <= F.col("cut")))))
    sure = now.where("sure")
    # of two that chose each other the lesser is the root, and so are those that wait
    back = sure.select(F.col("p").alias("q"), F.col("q").alias("p2"))
    mine = F.when(~F.col("sure") | ((F.col("p2") == F.col("p")) & (F.col("p") < F.col("q"))), F.col("p")).otherwise(F.col("q"))
    return sure.select("e.a", "e.b", "e.w").distinct(), _jumped(store(now.join(back, "q", "left").select("p", mine.alias("r"))), store)


def _merged_in_task(left: DataFrame, ends: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """As `_merged`, all rounds until none is sure, of LEVEL edges at most."""

    def rounds(edges: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        edges, ends = edges.sort_values(["w", "a", "b"]), ends
        # cuts as the number of edges up to them
        w, a, b = (edges[c].to_numpy() for c in "wab")
        upto, all_of = np.full(len(ends), len(w)), np.lexsort(tuple(np.concatenate((edges[c].to_numpy(), ends[c].to_numpy())) for c in "baw"))
        is_edge = all_of < len(w)
        upto[all_of[~is_edge] - len(w)] = is_edge.cumsum()[~is_edge]
        names, first = np.unique(ends["p"].to_numpy(), return_index=True)
        limit, comp = upto[first], np.arange(len(names))
        p, q, at, taken = np.searchsorted(names, edges["p"].to_numpy()), np.searchsorted(names, edges["q"].to_numpy()), np.arange(len(w)), []
        while len(at):
            x, y = comp[p[at]], comp[q[at]]
            at, x, y = at[x != y], x[x != y], y[x != y]
            best, other = np.full(len(names), len(w)), np.arange(len(names))
            # edges are in order, so the first of a component is its least
            for mine, its in ((x, y), (y, x)):
                u, i = np.unique(mine, return_index=True)
                less = at[i] < best[u]
                best[u[less]], other[u[less]] = at[i[less]], its[i[less]]
            sure = best < limit
            if not sure.any():
                break
            taken.append(np.unique(best[sure]))
            root = np.where(sure, other, np.arange(len(names)))
            mutual = (root[root] == np.arange(len(names))) & (np.arange(len(names)) < root)
            root[mutual] = np.flatnonzero(mutual)
            while (root[root] != root).any():
                root = root[root]
            np.minimum.at(limit, root, limit)
            comp = root[comp]
        t = np.concatenate([*taken, np.zeros(0, np.int64)]).astype(np.int64)
        return pd.DataFrame({"kind": np.repeat([0, 1], [len(t), len(names)]), "a": np.concatenate((a[t], names)), "b": np.concatenate((b[t], names[comp])), "w": np.concatenate((w[t], np.zeros(len(names))))})

    one = left.select("p", "q", "e.*", F.lit(0).alias("g")).groupBy("g")
    no_cut = [F.coalesce(f"cut.{c}", F.lit(most).cast(kind)).alias(c) for c, most, kind in (("w", "inf", "double"), ("a", -1, "long"), ("b", -1, "long"))]
    made = store(one.cogroup(ends.select("p", *no_cut, F.lit(0).alias("g")).groupBy("g")).applyInPandas(rounds, "kind int, a long, b long, w double"))
    return made.where("kind = 0").select("a", "b", "w"), made.where("kind = 1").select(F.col("a").alias("p"), F.col("b").alias("r"))


def spanning_tree(points: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """a, b, w: the n - 1 edges of the minimum spanning tree under mutual reachability with the k-th other point."""
    spark, most = points.sparkSession, max(k, NEAR)
    with Store(spark) as store:
        bare = store(points.select("seq", "embedding"))
        near = store(scan.nearest(bare, most, metric, DIGITS))
        # what is not in a point's list is no nearer than its last; a list of all others leaves nothing out
        n = bare.count()
        last = F.element_at("near", -1)["distance"]
        cut = F.when(F.lit(n - 1 > most), F.struct(last.alias("w"), F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")))
        core = F.element_at("near", F.least(F.lit(k), F.size("near")))["distance"]
        known = store(near.select(F.col("i").alias("seq"), core.alias("core"), cut.alias("cut")))
        cored = store(bare.join(known.select("seq", "core"), "seq"))
        c = known.select(F.col("seq").alias("j"), F.col("core").alias("core_j"))
        listed = near.join(known.select(F.col("seq").alias("i"), "core"), "i").select("i", "core", F.explode("near").alias("x")).select("i", "core", "x.j", "x.distance").join(c, "j")
        left = store(_contracted(listed.select(F.col("i").alias("p"), F.col("j").alias("q"), _edge("i", "j", F.greatest("core", "core_j", "distance")).alias("e"))))
        cuts, at = known.select("seq", "cut"), known.select("seq", F.col("seq").alias("comp"))
        ends = known.select(F.col("seq").alias("p"), "cut")
        tree: list[DataFrame] = []
        while True:
            edges, up = (_merged_in_task if left.count() <= LEVEL else _merged)(left, ends, store)
            if edges.isEmpty():
                if ends.count() < 2:
                    break
                # points whose list ends before their component's least known edge look outside of it
                best = left.union(left.select("q", "p", "e")).groupBy(F.col("p").alias("comp")).agg(F.min("e").alias("e"))
                comp = at.join(best, "comp", "left").join(cuts, "seq")
                rows = store(comp.where("cut is not null and (e is null or cut < e)").select("seq", "comp").join(cored, "seq"))
                found = store(scan.nearest(rows, most, metric, DIGITS, at.join(cored, "seq")))
                seen = found.select(F.col("i").alias("seq"), F.when(F.size("near") == most, _edge("i", F.element_at("near", -1)["j"], F.element_at("near", -1)["distance"])).alias("new"))
                looked = rows.select("seq", F.lit(True).alias("looked")).join(seen, "seq", "left")
                cuts = store(cuts.join(looked, "seq", "left").select("seq", F.when(F.col("looked"), F.col("new")).otherwise(F.col("cut")).alias("cut")))
                each = found.select("i", F.explode("near").alias("x")).select("i", "x.j", "x.distance")
                of = lambda c, name: at.select(F.col("seq").alias(c), F.col("comp").alias(name))
                more = each.join(of("i", "p"), "i").join(of("j", "q"), "j").select("p", "q", _edge("i", "j", F.col("distance")).alias("e"))
                left = store(_contracted(left.union(more)))
                ends = store(at.join(cuts, "seq").groupBy(F.col("comp").alias("p")).agg(F.min("cut").alias("cut")))
                continue
            tree.append(edges)
            at = store(at.join(up.withColumnRenamed("p", "comp"), "comp").select("seq", F.col("r").alias("comp")))
            ends = store(ends.join(up, "p").groupBy(F.col("r").alias("p")).agg(F.min("cut").alias("cut")))
            low, high = up.select("p", F.col("r").alias("rp")), up.select(F.col("p").alias("q"), F.col("r").alias("rq"))
            left = store(_contracted(left.join(low, "p").join(high, "q").where("rp <> rq").select(F.col("rp").alias("p"), F.col("rq").alias("q"), "e")))
        out = spark.createDataFrame([], "a long, b long, w double")
        for edges in tree:
            out = out.union(edges)
        return Store(spark)(out.select("a", "b", "w"))


def _merging(first: int, least: int):
    return lambda pdf: _merge_level(pdf, first, least)


def _merge_level(pdf: pd.DataFrame, first: int, least: int) -> pd.DataFrame:
    """A level's merges in order: rows of nodes (kind 0) and of what each component has become (kind 1).

    A component has its node, its size, the open cluster's sums of sizes times lambda (s1) and of sizes (s0),
    from which its mass follows when it ends, and the best mass below it.
    """
    pdf = pdf.sort_values(["w", "a", "b"])
    root: dict[int, int] = {}
    held: dict[int, tuple] = {}

    def find(i):
        while i in root:
            if root[i] in root:
                root[i] = root[root[i]]
            i = root[i]
        return i

    began, nodes = [], []
    for side in ("a", "b"):
        for r in zip(*[pdf[f"{c}_{side}"].tolist() for c in ("node", "size", "s1", "s0", "below")]):
            if r[0] not in held:
                held[r[0]] = r[1:]
                began.append(r[0])
    for at, (x, y, w) in enumerate(zip(pdf["node_a"].tolist(), pdf["node_b"].tolist(), pdf["w"].tolist())):
        x, y, node = find(x), find(y), -(first + at) - 1
        lam, parts = 1 / max(w, 1e-12), [held.pop(x), held.pop(y)]
        size = parts[0][0] + parts[1][0]
        big = [p[0] >= least for p in parts]
        chosen = [False, False]
        if all(big):
            # both clusters end here, and a new one is open from here up
            below = 0.0
            for i, (_, s1, s0, under) in enumerate(parts):
                mass = s1 - s0 * lam
                chosen[i] = mass >= under
                below += max(mass, under)
            held[node] = (size, size * lam, float(size), below)
        elif any(big):
            _, s1, s0, below = parts[big.index(True)]
            fell = parts[big.index(False)][0]
            held[node] = (size, s1 + fell * lam, s0 + fell, below)
        else:
            held[node] = (size, size * lam, float(size), 0.0)
        root[x] = root[y] = node
        nodes.append((0, node, x, y, chosen[0], chosen[1], size, 0.0, 0.0, 0.0))
    became = [(1, i, find(i), 0, False, False, *held[find(i)]) for i in began]
    return pd.DataFrame(nodes + became, columns=["kind", "node", "x", "y", "chosen_x", "chosen_y", "size", "s1", "s0", "below"])


def _pass_down(nodes: pd.DataFrame, owners: dict[int, int]) -> pd.DataFrame:
    """From the level's last merge down: what each part below the level belongs to, or points alone."""
    out = []
    for node, x, y, cx, cy in sorted(zip(*[nodes[c].tolist() for c in ("node", "x", "y", "chosen_x", "chosen_y")])):
        up = owners.pop(node, None)
        for kid, chosen in ((x, cx), (y, cy)):
            owner = up if up is not None else (kid if chosen else None)
            if kid < 0:
                owners[kid] = owner
            else:
                out.append((kid, owner))
    return pd.DataFrame(out + list(owners.items()), columns=["node", "owner"]).astype({"node": "int64", "owner": "Int64"})


def extract(tree: DataFrame, least: int = 4, level: int | None = None) -> DataFrame:
    """seq, cluster: of each point of a spanning tree, the chosen cluster by excess of mass, or null for noise.

    A cluster's number is that of its topmost node, negative.
    """
    if least < 2:
        raise ValueError("a cluster has two points at least")
    spark, result = tree.sparkSession, Store(tree.sparkSession)
    point = lambda c: F.struct(F.col(c).alias("node"), F.lit(1).cast("long").alias("size"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s0"), F.lit(0.0).alias("below"))
    with Store(spark) as store:
        n = tree.count()
        levels = max(1, -(-n // (level or LEVEL)))
        ranged = tree.repartitionByRange(levels, "w", "a", "b") if levels > 1 else tree.coalesce(1)
        left = store(ranged.select("a", "b", "w", F.spark_partition_id().alias("level"), point("a").alias("pa"), point("b").alias("pb")))
        counts = dict(left.groupBy("level").count().collect())
        first, found = 0, []
        for g in sorted(counts):
            rows = left.where(F.col("level") == g).select("a", "b", "w", *[F.col(f"p{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("node", "size", "s1", "s0", "below")])

            made = store(rows.groupBy(F.lit(g).alias("level")).applyInPandas(_merging(first, least), "kind int, node long, x long, y long, chosen_x boolean, chosen_y boolean, size long, s1 double, s0 double, below double"))
            found.append((first, made.where("kind = 0")))
            first += counts[g]
            now = made.where("kind = 1").select("node", F.struct(F.col("x").alias("node"), "size", "s1", "s0", "below").alias("p"))
            left = left.where(F.col("level") > g)
            for s in "ab":
                new = now.select(F.col("node").alias("_n"), F.col("p").alias("_p"))
                left = left.join(new, left[f"p{s}"]["node"] == F.col("_n"), "left").withColumn(f"p{s}", F.coalesce("_p", f"p{s}")).drop("_n", "_p")
            left = store(left)
        # owners of nodes of lower levels and of points, level by level from the top
        given: list[DataFrame] = []
        for at, nodes in reversed(found):
            mine = [x.where(F.col("node").between(-(at + counts_of(found, at, first)), -at - 1)) for x in given]
            own = spark.createDataFrame([], "node long, owner long")
            for x in mine:
                own = own.union(x)

            def down(ns: pd.DataFrame, os: pd.DataFrame) -> pd.DataFrame:
                return _pass_down(ns, {int(a): None if pd.isna(b) else int(b) for a, b in zip(os["node"], os["owner"])})

            sent = nodes.withColumn("g", F.lit(0)).groupBy("g").cogroup(own.withColumn("g", F.lit(0)).groupBy("g")).applyInPandas(down, "node long, owner long")
            given.append(store(sent))
        points = [x.where("node >= 0") for x in given]
        out = points[0] if points else spark.createDataFrame([], "node long, owner long")
        for x in points[1:]:
            out = out.union(x)
        return result(out.select(F.col("node").alias("seq"), F.col("owner").alias("cluster")))


def counts_of(found: list, at: int, total: int) -> int:
    """Merges of the level that begins at a rank."""
    return min([f for f, _ in found if f > at], default=total) - at


def cluster(points: DataFrame, least: int = 4, k: int = 2, metric: str = "euclidean") -> DataFrame:
    """seq, pred: the least seq of the point's cluster, or -1 for noise; all noise below max(2, least) points."""
    out = extract(spanning_tree(points, k, metric), least)
    names = out.where("cluster is not null").groupBy("cluster").agg(F.min("seq").alias("pred"))
    named = out.join(names, "cluster", "left").select("seq", "pred")
    return points.select("seq").join(named, "seq", "left").select("seq", F.coalesce("pred", F.lit(-1)).cast("long").alias("pred"))
