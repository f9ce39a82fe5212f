"""Structured Streaming: online assignment and gated methods with keyed state.

A stream is a key; its method object is the state.  Rows of a micro-batch arrive in any
order and are sorted by seq, so that a replay in one batch and a stream agree.  Online
assignment keeps its centroids only; methods that refit a prefix keep that prefix.
"""

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from ..plans.methods import Config, Online, method as method_of


def assign_stream(points: DataFrame, method: str = "diart_style", config: Config = Config()) -> DataFrame:
    """stream_id, seq, pred, action of a streaming frame of (stream_id, seq, embedding)."""

    def run(key, batches, state):
        m = pickle.loads(state.get[0]) if state.exists else method_of(method, config)
        pdf = pd.concat(list(batches)).sort_values("seq")
        rows = []
        for seq, v in zip(pdf["seq"], pdf["embedding"]):
            action = m.update(np.asarray(v, np.float32))
            labels = m.labels or m.evaluation()[1]
            rows.append((key[0], seq, int(labels[-1]), action))
            if isinstance(m, Online):
                m.labels.clear()  # centroids and counts are all that the next arrival needs
        state.update((pickle.dumps(m),))
        yield pd.DataFrame(rows, columns=["stream_id", "seq", "pred", "action"])

    keyed = points.select("stream_id", "seq", "embedding").groupBy("stream_id")
    return keyed.applyInPandasWithState(run, "stream_id string, seq long, pred long, action string", "method binary", "append", GroupStateTimeout.NoTimeout)
