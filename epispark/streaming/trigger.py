"""Refresh trigger with memory: as a column, as a batch job and as a stateful stream.

The trigger fires at the episode start, when the hard timer runs out, on a hard drift, on a soft
drift after the cooldown, and on a positive completion score; firing resets the timer and commits
the current vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from epispark.scale import BLOCK, Halo, in_key_order
from epispark.streaming.groups import map_groups


@dataclass(frozen=True)
class TriggerConfig:
    tau_hard: float = 0.20
    tau_soft: float = 0.06
    timer_hard: int = 60
    timer_soft: int = 30

    def fires(self, elapsed, drift, logit):
        """Predicate past the start, for numbers and arrays alike."""
        return (
            (elapsed >= self.timer_hard)
            | (drift > self.tau_hard)
            | ((drift > self.tau_soft) & (elapsed >= self.timer_soft))
            | (logit > 0)
        )


def should_refresh(
    t: Column,
    drift: Column,
    last: Column,
    logit: Column,
    config: TriggerConfig = TriggerConfig(),
    start: Column | None = None,
) -> Column:
    """The predicate as a column where the last refresh is already known."""
    begin = (t == 0) if start is None else start
    return begin | (last < 0) | config.fires(t - last, drift, logit)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)


class _Block:
    """One block of an episode with the frames of the timer before it.

    The only state is the age of the last refresh (1 .. timer at block entry), because a refresh is
    certain once the hard timer is reached; so a block is a function from entry age to exit age.
    """

    def __init__(self, pdf: pd.DataFrame, config: TriggerConfig, size: int, vector: bool):
        self.cfg = config
        self.t = pdf["t"].to_numpy()
        block = int(pdf["__block"].iloc[0])
        self.own = np.flatnonzero(self.t >= block * size)
        self.first = block * size
        self.logit = pdf["logit"].to_numpy(float)
        self.drift = None if vector else pdf["drift"].to_numpy(float)
        self.unit = _unit(np.stack(pdf["vector"].to_numpy()).astype(float)) if vector else None

    def drift_at(self, i: int, ages: np.ndarray):
        """Drift of row ``i`` against the vector committed ``ages`` frames ago."""
        if self.unit is None:
            return self.drift[i]
        # rows are consecutive frames, so the committed row is found by its age
        j = np.maximum(i - ages, 0)
        return 1.0 - self.unit[j] @ self.unit[i]

    def run_known(self, age: int):
        """Advance one known entry age; returns refresh flags and drifts of the own rows."""
        last, cfg = self.first - age, self.cfg
        fired, drifts = [], []
        drift = None if self.drift is None else self.drift.tolist()
        logit, times = self.logit.tolist(), self.t.tolist()
        for i in self.own.tolist():
            t = times[i]
            if t == 0:
                hit, d = True, float("nan")
            else:
                d = drift[i] if drift is not None else 1.0 - float(
                    self.unit[i - (t - last)] @ self.unit[i]
                )
                hit = cfg.fires(t - last, d, logit[i])
            if hit:
                last = t
            fired.append(hit)
            drifts.append(d)
        return np.array(fired, dtype=bool), np.array(drifts, dtype=float)

    def run(self, ages: np.ndarray):
        """Advance all given entry ages together; returns exit ages and refresh counts."""
        last = self.first - ages
        count = np.zeros(len(ages), dtype=np.int64)
        for i in self.own:
            t = self.t[i]
            if t == 0:
                hit = np.ones(len(ages), dtype=bool)
            else:
                age = t - last
                hit = self.cfg.fires(age, self.drift_at(i, age), self.logit[i])
            last = np.where(hit, t, last)
            count += hit
        exit_age = self.t[self.own[-1]] + 1 - last
        return exit_age, count


def refresh_batch(
    df: DataFrame,
    key: str,
    t: str,
    logit: Column,
    drift: Column | None = None,
    vector: Column | None = None,
    config: TriggerConfig = TriggerConfig(),
    size: int = BLOCK,
) -> DataFrame:
    """Replay the trigger over a table: ``key, t, refreshed, drift, refresh_count``.

    Give either the drift itself or the vector it is measured on (cosine distance to the committed
    one). Frames are dense from 0. A long episode is cut into blocks: each block is first reduced to
    its entry-age table, the tables are chained per episode (one small row per block), and then all
    blocks run in parallel from their known entry age.
    """
    if (drift is None) == (vector is None):
        raise ValueError("give either drift or vector")
    if size < config.timer_hard:
        raise ValueError("a block must be at least as long as the hard timer")
    is_vector = vector is not None
    payload = vector.cast("array<double>").alias("vector") if is_vector else drift.alias("drift")
    rows = df.select(F.col(key), F.col(t).cast("long").alias("t"), logit.alias("logit"), payload)
    ktype = df.schema[key].dataType.simpleString()
    halo = Halo(rows, [key], "t", before=config.timer_hard, size=size)
    # copies beyond an episode's end form blocks without own rows
    blocks = halo.df.withColumn("__block", F.col("__block").cast("long"))
    ages = np.arange(1, config.timer_hard + 1)

    def table_of(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _Block(pdf, config, size, is_vector)
        if len(b.own) == 0:
            return pd.DataFrame({key: [], "block": [], "exits": [], "counts": []})
        entry = ages if b.first else ages[:1]
        exits, counts = b.run(entry)
        return pd.DataFrame(
            {key: [pdf[key].iloc[0]], "block": [b.first // size], "exits": [exits],
             "counts": [counts]}
        )

    long_keys = rows.where(F.col("t") >= size).select(key).distinct()
    tables = map_groups(
        blocks.join(long_keys, key, "left_semi"), [key, "__block"], ["t"], table_of,
        f"{key} {ktype}, block long, exits array<long>, counts array<long>",
    )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, age, total = None, 1, 0
        for pdf in batches:
            entry, before = [], []
            for k, exits, counts in zip(pdf[key], pdf["exits"], pdf["counts"]):
                if k != current:
                    current, age, total = k, 1, 0
                entry.append(age)
                before.append(total)
                slot = min(age, len(exits)) - 1
                age, total = int(exits[slot]), total + int(counts[slot])
            yield pd.DataFrame(
                {key: pdf[key], "__block": pdf["block"], "entry": entry, "before": before}
            )

    entries = in_key_order(tables, [key], "block").mapInPandas(
        chain, f"{key} {ktype}, __block long, entry long, before long"
    )

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        b = _Block(pdf, config, size, is_vector)
        if len(b.own) == 0:
            return pd.DataFrame({key: [], "t": [], "refreshed": [], "drift": [], "n": []})
        fired, drifts = b.run_known(int(pdf["entry"].iloc[0]))
        return pd.DataFrame(
            {key: pdf[key].to_numpy()[b.own], "t": b.t[b.own], "refreshed": fired,
             "drift": drifts, "n": pdf["before"].iloc[0] + np.cumsum(fired)}
        )

    known = blocks.join(entries, [key, "__block"], "left").fillna({"entry": 1, "before": 0})
    out = map_groups(
        known, [key, "__block"], ["t"], replay,
        f"{key} {ktype}, t long, refreshed boolean, drift double, n long",
    )
    return out.select(
        key, F.col("t").alias(t), "refreshed", F.nanvl("drift", F.lit(None)).alias("drift"),
        F.col("n").alias("refresh_count"),
    )


TRIGGER_OUTPUT = (
    "episode long, t long, refreshed boolean, drift double, refresh_count long, history int"
)
TRIGGER_COLUMNS = ["episode", "t", "refreshed", "drift", "refresh_count", "history"]


class TriggerProcessor(StatefulProcessor):
    """Per-episode trigger on a stream of ``episode, t, logit`` and ``drift`` or ``vector``.

    State: frame of the last refresh, refresh count, committed vector, and the last ``history``
    observations, which are appended after the decision. Frame 0 starts from a clean state. Rows of
    one micro-batch are ordered here, so bound the micro-batch (``files_per_trigger``); across
    micro-batches input must arrive in frame order. History of any length is replayed in batch by
    :func:`refresh_batch`, which splits long episodes.
    """

    def __init__(self, config: TriggerConfig = TriggerConfig(), history: int = 16,
                 ttl_ms: int | None = None):
        self.cfg, self.history_size, self.ttl = config, history, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        vec = T.StructType([T.StructField("v", T.ArrayType(T.DoubleType()))])
        facts = T.StructType(
            [T.StructField("last", T.LongType()), T.StructField("count", T.LongType())]
        )
        self.facts = handle.getValueState("facts", facts, self.ttl)
        self.committed = handle.getValueState("committed", vec, self.ttl)
        self.history = handle.getListState("history", vec, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("t", ignore_index=True)
        with_vector = "vector" in pdf.columns
        last, count = self.facts.get() if self.facts.exists() else (-1, 0)
        committed = np.asarray(self.committed.get()[0]) if self.committed.exists() else None
        seen = [list(v[0]) for v in self.history.get()] if self.history.exists() else []
        out = []
        for i, (t, logit) in enumerate(zip(pdf["t"], pdf["logit"])):
            t = int(t)
            if t == 0:
                last, count, committed, seen = -1, 0, None, []
            now = np.asarray(pdf["vector"][i], float) if with_vector else None
            drift = None
            if t != 0 and last >= 0:
                if with_vector:
                    a, b = _unit(np.stack([now, committed]))
                    drift = float(1.0 - a @ b)
                else:
                    drift = float(pdf["drift"][i])
            fire = t == 0 or last < 0 or bool(self.cfg.fires(t - last, drift, float(logit)))
            out.append((key[0], t, fire, drift, count + fire, len(seen)))
            if fire:
                last, count, committed = t, count + 1, now
            seen.append([float(x) for x in now] if with_vector else [float(pdf["drift"][i])])
            seen = seen[-self.history_size :]
        self.facts.update((last, count))
        if committed is not None:
            self.committed.update(([float(x) for x in committed],))
        self.history.put([(v,) for v in seen])
        yield pd.DataFrame(out, columns=TRIGGER_COLUMNS)

    def close(self) -> None:
        pass


def use_rocksdb(df: DataFrame) -> None:
    """Arbitrary state needs the RocksDB store; set it unless the session names one."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(
            name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        )


def refresh_stream(
    stream: DataFrame, config: TriggerConfig = TriggerConfig(), history: int = 16,
    ttl_ms: int | None = None,
) -> DataFrame:
    """Stateful form of :func:`refresh_batch` for a stream keyed by ``episode``."""
    use_rocksdb(stream)
    return stream.groupBy("episode").transformWithStateInPandas(
        statefulProcessor=TriggerProcessor(config, history, ttl_ms),
        outputStructType=T.StructType.fromDDL(TRIGGER_OUTPUT),
        outputMode="Append",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


ENSEMBLE_OUTPUT = "episode long, t long, action array<double>, n_preds int"


class EnsembleProcessor(StatefulProcessor):
    """Online ensemble: each row brings the predictions for its step and the following ones
    (``chunk array<array<double>>``); the last ``horizon`` chunks are kept."""

    def __init__(self, horizon: int, alpha: float = 0.0):
        self.horizon, self.alpha = horizon, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        item = T.StructType([T.StructField("c", T.ArrayType(T.ArrayType(T.DoubleType())))])
        self.chunks = handle.getListState("chunks", item)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values("t", ignore_index=True)
        t = pdf["t"].to_numpy()
        raw = [] if t[0] == 0 else [c[0] for c in self.chunks.get()]
        old = len(raw)
        raw += pdf["chunk"].tolist()
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.array([x for c in raw for x in c], float)
        # chunks x steps x dimensions; missing steps of shorter chunks are never read
        chunks = np.full((len(raw), max(self.horizon, size.max()), flat.shape[1]), np.nan)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        chunks[np.repeat(np.arange(len(raw)), size), step] = flat
        own = np.arange(old, len(raw))
        # rows from the latest start on; chunks before it are forgotten
        start = np.maximum.accumulate(np.where(t == 0, own, 0))
        n = np.minimum(own - start + 1, self.horizon)
        ref = chunks[own, 0]
        weight, total = np.zeros(len(own)), np.zeros_like(ref)
        for age in range(int(n.max())):
            at = np.flatnonzero(n > age)
            if (size[own[at] - age] <= age).any():
                raise IndexError(f"a chunk has no prediction for {age} steps ahead")
            pred, near = chunks[own[at] - age, age], ref[at]
            cos = (pred * near).sum(1) / (np.linalg.norm(pred, axis=1) * np.linalg.norm(near, axis=1) + 1e-7)
            w = np.exp(self.alpha * cos)
            weight[at] += w
            total[at] += w[:, None] * pred
        last = range(len(raw) - n[-1], len(raw))
        self.chunks.put([(chunks[i, : size[i]].tolist(),) for i in last])
        yield pd.DataFrame({
            "episode": key[0], "t": t, "action": list(total / weight[:, None]), "n_preds": n.astype(np.int32)})

    def close(self) -> None:
        pass


def ensemble_stream(stream: DataFrame, horizon: int, alpha: float = 0.0) -> DataFrame:
    use_rocksdb(stream)
    return stream.groupBy("episode").transformWithStateInPandas(
        statefulProcessor=EnsembleProcessor(horizon, alpha),
        outputStructType=T.StructType.fromDDL(ENSEMBLE_OUTPUT),
        outputMode="Append",
        timeMode="None",
    )


