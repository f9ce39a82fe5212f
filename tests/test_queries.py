"""Queries that read the data folder's embeddings."""

import numpy as np
import pytest

from driftline import queries
from driftline.plans import methods as P
from driftline.sources import streams as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """90 points of 16 dimensions."""
    pdf = S.synthetic(5, 18, 16, 7)
    rows = spark.createDataFrame(pdf.assign(embedding=pdf["embedding"].map(lambda v: v.tolist())), "seq long, embedding array<float>, label long")
    at = str(tmp_path_factory.mktemp("data"))
    rows.withColumnRenamed("seq", "vec_id").write.parquet(f"{at}/embeddings.parquet")
    return at


def test_methods_replay_the_table(spark, folder):
    points = S.stream(spark, f"{folder}/embeddings.parquet")
    want = P.replay(points, list(P.METHODS), P.Config(checkpoint=1 << 30)).toPandas()
    for name in P.METHODS:
        got = queries.QUERIES[f"method_{name}"](spark, folder).toPandas().sort_values("seq")
        assert got["seq"].tolist() == list(range(90)), name
        of = want[want["method"] == name].sort_values("seq")
        assert all(got[c].tolist() == of[c].tolist() for c in got.columns), name


def test_every_point_is_judged(spark, folder):
    rows = S.stream(spark, f"{folder}/embeddings.parquet").toPandas().sort_values("seq")
    x, label = np.stack(rows["embedding"].to_list()).astype(float), rows["label"].to_numpy()
    names = np.unique(label)
    reps = np.array([x[label == n].sum(0) / np.linalg.norm(x[label == n].sum(0)) for n in names])
    d = 1 - np.clip(x @ reps.T, -1, 1)
    spread = np.array([np.percentile(d[label == n, i], 95) for i, n in enumerate(names)])
    near = d.argmin(1)
    want = np.where(d[np.arange(len(x)), near] <= 1.5 * spread[near], names[near], -1)
    got = queries.QUERIES["noise_reinsertion_all"](spark, folder).toPandas().sort_values("seq")
    assert got["seq"].tolist() == list(range(90))
    assert got["label"].tolist() == want.tolist()
