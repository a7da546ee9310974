"""The hidden states' weights carried along a stream of returns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import hmm

SCHEMA = "code string, date date, calm double, bear_grind double, volatile_reversal double"


def filtered_stream(returns: DataFrame, models: DataFrame) -> DataFrame:
    """Weights after each return of a stream (code, date, r), under the frozen model of its code (code, start, trans, mu,
    sigma). The weights of a code are its state; returns no later than the last one seen are left out, so a batch that is
    run again or comes late changes nothing. A batch's returns of a code are taken in order of their dates."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("date", kind="stable").drop_duplicates("date", keep="last")
        alpha, last = (np.array(state.get[0]), state.get[1]) if state.exists else (None, "")
        rows = rows[rows.date.astype(str) > last]
        if not len(rows):
            return
        one = rows.iloc[0]
        m = hmm.Model(np.array(one.start), np.array(one.trans).reshape(len(one.mu), -1), np.array(one.mu), np.array(one.sigma), reliable=True)
        out = hmm.filtered(rows.r.to_numpy(float), m, start=alpha)
        state.update((out[-1].tolist(), str(rows.date.iloc[-1])))
        yield pd.DataFrame({"code": key[0], "date": rows.date.to_numpy(), **dict(zip(hmm.NAMES, out.T, strict=True))})

    joined = returns.join(models.select("code", "trans", "mu", "sigma", "start"), "code")
    return joined.groupBy("code").applyInPandasWithState(step, SCHEMA, "alpha array<double>, last string", "append", GroupStateTimeout.NoTimeout)
