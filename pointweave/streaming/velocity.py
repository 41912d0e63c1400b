"""The velocity buffer as a stateful stream: what the last seconds of samples hold, per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "key string, t double, held bigint, mean double"
STATE = "times array<double>, vals array<double>"


def velocity_buffer(samples: DataFrame, seconds: float = 1.5) -> DataFrame:
    """For each sample ``key, t, value`` the number and mean of the key's samples in the last ``seconds``.

    A later sample evicts what is too old for it, a late one evicts nothing
    newer, and an equal time is overwritten.  The state of a key is bounded
    by its rate times the window.
    """

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*map(list, state.get), strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t, v in zip(rows["t"].tolist(), rows["value"].tolist(), strict=True):
            held[t] = v
            held = {k: x for k, x in held.items() if k >= t - seconds}
            now = [x for k, x in held.items() if k <= t]
            out.append((key[0], t, len(now), sum(now) / len(now)))
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=["key", "t", "held", "mean"])

    return samples.groupBy("key").applyInPandasWithState(update, OUTPUT, STATE, "append", "NoTimeout")
