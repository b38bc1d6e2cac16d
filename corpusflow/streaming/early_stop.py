"""Early stopping as keyed streaming state."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISION = "run string, step bigint, best double, since_improved bigint, improved boolean, stop boolean"


#: Steps that one entry of the ordered state holds, and evaluations of a bucket that are held before they go there.
CHUNK, HELD_ROWS = 4096, 1 << 18
#: Buckets of runs, one key of state each; must not change during the life of a checkpoint.
BUCKETS = 1024
#: Parts in which a bucket's waiting evaluations are folded, by run.
PARTS = 64


class EarlyStop(StatefulProcessor):
    """Keeps (best, since improved, stopped) per run and emits one decision per evaluation.

    Runs are keyed by bucket, and the folds of a bucket are read and written as
    one list, so calls to the state store follow the buckets, not the runs.
    Evaluations of one batch are applied in step order; a run that stopped
    emits nothing more. A bucket with more than ``held_rows`` evaluations puts
    them into map state by part and range of steps, and the fold reads one range
    after another, so neither side of it holds a whole run.
    """

    def __init__(self, sign: float, min_delta: float, patience: int, held_rows: int = HELD_ROWS) -> None:
        self.sign, self.min_delta, self.patience, self.held_rows = sign, min_delta, patience, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("folds", "run string, best double, since bigint, stopped boolean")
        self.waiting = handle.getMapState("waiting", "part bigint, chunk bigint, piece bigint", "runs array<string>, steps array<bigint>, values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        stored = self.state.get() if self.state.exists() else ()
        folds = {run: (None if best is None or pd.isna(best) else float(best), since, stopped) for run, best, since, stopped in stored}
        held: list[pd.DataFrame] = []
        places: dict[tuple[int, int], int] = {}
        for frame in rows:
            held.append(frame[["run", "step", "value"]])
            if sum(map(len, held)) >= self.held_rows:
                self.wait(pd.concat(held), places)
                held = []
        if places:
            if held:
                self.wait(pd.concat(held), places)
            for part, chunk in sorted(places):
                pieces = (self.waiting.getValue((part, chunk, piece)) for piece in range(places[part, chunk]))
                yield self.decided(folds, pd.concat([pd.DataFrame({"run": list(r), "step": list(s), "value": list(v)}) for r, s, v in pieces]))
            self.waiting.clear()
        elif held:
            yield self.decided(folds, pd.concat(held))
        self.state.put([(run, *fold) for run, fold in folds.items()])

    def wait(self, frame: pd.DataFrame, places: dict[tuple[int, int], int]) -> None:
        """Puts evaluations into state by part and range of steps, as one more piece of each; ``places`` counts the pieces."""
        part = np.array([zlib.crc32(str(run).encode()) % PARTS for run in frame["run"]])
        for (at, chunk), some in frame.groupby([part, frame["step"].to_numpy() // CHUNK], sort=False):
            place = (int(at), int(chunk))
            piece = places.get(place, 0)
            values = [None if pd.isna(v) else float(v) for v in some["value"]]
            self.waiting.updateValue((*place, piece), (some["run"].tolist(), some["step"].astype(int).tolist(), values))
            places[place] = piece + 1

    def decided(self, folds: dict, frame: pd.DataFrame) -> pd.DataFrame:
        """Decisions in order of steps, within a step as they came; ``folds`` goes on from them."""
        order = np.lexsort((frame["step"].to_numpy(), pd.factorize(frame["run"])[0]))
        out = []
        for run, step, value in frame.iloc[order].itertuples(index=False, name=None):
            run = None if pd.isna(run) else run
            best, since, stopped = folds.get(run, (None, 0, False))
            if stopped:
                continue
            v = None if pd.isna(value) else float(value) * self.sign
            improved = v is not None and (best is None or v - best > self.min_delta)
            best, since = (v, 0) if improved else (best, since + 1)
            stopped = since >= self.patience
            folds[run] = (best, since, stopped)
            out.append((run, int(step), None if best is None else best * self.sign, since, improved, stopped))
        return pd.DataFrame(out, columns=["run", "step", "best", "since_improved", "improved", "stop"]).astype({"best": "float64"})

    def close(self) -> None:
        pass


def stream_early_stop(evals: DataFrame, mode: str = "max", min_delta: float = 0.0, patience: int = 3, buckets: int = BUCKETS, held_rows: int = HELD_ROWS) -> DataFrame:
    """Decisions for a stream of ``(run, step, value)``; needs the RocksDB state store."""
    rows = evals.select(F.col("run").cast("string").alias("run"), F.col("step").cast("bigint").alias("step"), F.col("value").cast("double").alias("value"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("run"), F.lit(buckets)).cast("int")).groupBy("bucket").transformWithStateInPandas(
        EarlyStop(1.0 if mode == "max" else -1.0, min_delta, patience, held_rows),
        outputStructType=DECISION, outputMode="Append", timeMode="None",
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
