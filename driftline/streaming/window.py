"""The count window with keyed list state: the last `cap` arrivals of a stream are its state, and no more.

Each arrival is labelled by a fit of the window that ends with it.  Arrivals of a stream come in
order of seq within a micro-batch, and across micro-batches as the source has them.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import density
from ..plans.methods import Config

#: The state store that list state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CountWindow(StatefulProcessor):
    def __init__(self, config: Config):
        self.c = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "seq long, embedding array<float>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        window = [(seq, np.asarray(v, np.float32)) for seq, v in self.held.get()] if self.held.exists() else []
        out = []
        for seq, v in pd.concat(list(rows)).sort_values("seq")[["seq", "embedding"]].itertuples(index=False):
            window = [*window, (seq, np.asarray(v, np.float32))][-self.c.cap :]
            pred = density.cluster(np.stack([x for _, x in window]), "hdbscan", self.c.least, self.c.k)[-1]
            out.append((key[0], int(seq), int(pred), len(window)))
        self.held.put([(int(seq), [float(x) for x in v]) for seq, v in window])
        yield pd.DataFrame(out, columns=["stream_id", "seq", "pred", "held"])

    def close(self) -> None:
        pass


def window_stream(points: DataFrame, config: Config = Config()) -> DataFrame:
    """stream_id, seq, pred, held (the window's arrivals) of a streaming frame of (stream_id, seq, embedding)."""
    keyed = points.select("stream_id", "seq", "embedding").groupBy("stream_id")
    return keyed.transformWithStateInPandas(CountWindow(config), "stream_id string, seq long, pred long, held long", "Append", "None")
