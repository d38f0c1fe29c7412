"""Running centres over a stream: online k-means whose centres and weights are state.

``centres_from`` keeps them as list state that begins with a table, ``running_centres`` as one value
for each shard that begins with a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues


def running_centres(stream: DataFrame, initial: list[list[float]], shards: int = 8) -> DataFrame:
    """(shard, centre, coords, weight) after each batch of a stream (point_id, coords).

    Points are dealt over shards, each of which keeps its own centres; their mean
    by weight is the centre of the whole stream.  Points of a batch move centres
    in the order of their ids.
    """
    start = np.array(initial, float)
    k, d = start.shape

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            flat, weight = (np.array(x) for x in state.get)
            centres = flat.reshape(k, d)
        else:
            centres, weight = start.copy(), np.ones(k)
        rows = pd.concat(list(batches)).sort_values("point_id")
        for x in np.array(rows["coords"].tolist(), float).reshape(-1, d):
            i = int(((centres - x) ** 2).sum(1).argmin())
            centres[i] = (weight[i] * centres[i] + x) / (weight[i] + 1)
            weight[i] += 1
        state.update((centres.ravel().tolist(), weight.tolist()))
        yield pd.DataFrame({"shard": key[0], "centre": np.arange(k), "coords": centres.tolist(), "weight": weight})

    dealt = stream.withColumn("shard", F.pmod(F.xxhash64("point_id"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandasWithState(update, "shard long, centre long, coords array<double>, weight double", "flat array<double>, weight array<double>", "update", GroupStateTimeout.NoTimeout)


#: Centres of a shard as state, and what each batch gives of them.
_STATE = "centre long, coords array<double>, weight double"
#: The state store that list state needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Centres(StatefulProcessor):
    """The centres of a shard are a list in the state; its first rows come from a table."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.centres = handle.getListState("centres", _STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        self.centres.appendList([(int(r.centre), [float(v) for v in r.coords], float(r.weight)) for r in initialState.itertuples()])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = sorted(self.centres.get())
        if not held:
            raise ValueError("the table of first centres is empty")
        names, centres, weight = [h[0] for h in held], np.array([h[1] for h in held], float), np.array([h[2] for h in held])
        batch = pd.concat(list(rows)).sort_values("point_id")
        for x in np.array(batch["coords"].tolist(), float).reshape(-1, centres.shape[1]):
            i = int(((centres - x) ** 2).sum(1).argmin())
            centres[i] = (weight[i] * centres[i] + x) / (weight[i] + 1)
            weight[i] += 1
        out = list(zip(names, centres.tolist(), weight.tolist()))
        self.centres.put(out)
        yield pd.DataFrame({"shard": key[0], "centre": names, "coords": centres.tolist(), "weight": weight})


def centres_from(stream: DataFrame, initial: DataFrame, shards: int = 8) -> DataFrame:
    """(shard, centre, coords, weight) after each batch of a stream (point_id, coords), from a table of centres.

    ``initial`` is (centre, coords, weight): a first choice, whose weights are 1, or what ``merged_centres`` of an
    earlier stream gave. Each shard begins with all of it, at its share of the weight, so that the merged centres
    hold it once. Ties go to the first centre; a batch of a shard is held in one task. Rows without coordinates
    must be left out before. The session has to name ``STORE`` as spark.sql.streaming.stateStore.providerClass.
    """
    if stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    dealt = stream.select(F.pmod(F.xxhash64("point_id"), F.lit(shards)).alias("shard"), "point_id", "coords")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    first = initial.select(each, F.col("centre").cast("long").alias("centre"), "coords", (F.col("weight") / shards).alias("weight"))
    return dealt.groupBy("shard").transformWithStateInPandas(_Centres(), f"shard long, {_STATE}", "update", "none", first.groupBy("shard"))


def merged_centres(given: DataFrame, initial: DataFrame, shards: int = 8) -> DataFrame:
    """(centre, coords, weight): the last centres of all shards, their mean by weight; shards without points count as they began.

    ``given`` is all that the stream gave, in any order: a shard's last row is the one of the largest sum of weights.
    """
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard")
    began = initial.select(each, F.col("centre").cast("long").alias("centre"), "coords", (F.col("weight") / shards).alias("weight"))
    last = given.unionByName(began).groupBy("shard", "centre").agg(F.max(F.struct("weight", "coords")).alias("last")).select("centre", "last.*")
    parts = last.select("centre", "weight", F.posexplode("coords").alias("dim", "v"))
    means = parts.groupBy("centre", "dim").agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"), F.sum("weight").alias("weight"))
    return means.groupBy("centre").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "v"))), lambda r: r["v"]).alias("coords"), F.first("weight").alias("weight"))
