"""Batches of lines as they arrive: at most so many lines, at most so long held.

A keyed state holds the lines that aren't in a batch yet. A batch is emitted as
soon as ``most_lines`` are held, or ``window_ms`` after the first of them came,
whichever is first: the state's timer runs in processing time. Within a batch,
lines with a time are in its order, the others follow as they arrived. The name
of the last header is in the state too, so headers go on over batches and
restarts, and a batch costs no job beside the stream's own.

Lines arrive in the order of the source within each Arrow batch that a task gets
(time, file, generation, byte); a micro-batch isn't held whole anywhere. All lines
of one key are one task's: without ``by`` that is the whole stream, as one
console shows it; with ``by`` each key has batches and headers of its own.

Null times come last; null names are a name; lines of any length are kept whole.
The state store must be RocksDB (``configure_state`` sets it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINE = "file string, name string, arrival timestamp, ts timestamp, ts_nanos int, level string, message string, line string, shape string"
OUT = "batch_no long, pos long, header string, " + LINE
FIELDS = [f.split()[0] for f in LINE.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _typed(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.astype({"arrival": "datetime64[ns]", "ts": "datetime64[ns]", "ts_nanos": "Int32"})


def _frame(lines: list[tuple]) -> pd.DataFrame:
    return _typed(pd.DataFrame(lines, columns=FIELDS))


def _tuples(frame: pd.DataFrame) -> list[tuple]:
    frame = frame.astype(object)
    return list(frame.where(frame.notna(), None).itertuples(index=False, name=None))


class Batches(StatefulProcessor):
    def __init__(self, most_lines: int, window_ms: int, headers: str):
        self.most, self.window, self.headers = most_lines, window_ms, headers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", LINE)
        self.at = handle.getValueState("at", "batch_no long, pos long, last string, due long")

    def close(self) -> None:
        pass

    def _state(self) -> tuple[int, int, str | None, int]:
        return tuple(self.at.get()) if self.at.exists() else (0, 0, None, 0)

    def _batch(self, lines: list[tuple], number: int, pos: int, last: str | None) -> tuple[pd.DataFrame, int, str | None]:
        return self._batches(_frame(lines), number, pos, last)

    def _batches(self, lines: pd.DataFrame, number: int, pos: int, last: str | None) -> tuple[pd.DataFrame, int, str | None]:
        """Lines in batches of ``most_lines`` as they arrived, each in order; (batches, next position, last name)."""
        batch, late = np.arange(len(lines)) // self.most, lines["ts"].isna().to_numpy()
        ts = np.where(late, 0, lines["ts"].to_numpy().view(np.int64))
        nanos = np.where(late, 0, lines["ts_nanos"].fillna(0).to_numpy(np.int64))
        frame = lines.iloc[np.lexsort((nanos, ts, late, batch))].reset_index(drop=True)  # equal ones as they arrived
        names = frame["name"].astype(object).where(frame["name"].notna(), "").to_numpy()
        header = np.full(len(frame), None, object)
        if self.headers != "never":
            shown = np.ones(len(frame), bool) if self.headers == "every" else names != np.array([last, *names[:-1]], object)
            header[shown] = [f"==> {name} <==" for name in names[shown]]
        for k, (column, values) in enumerate({"batch_no": number + batch, "pos": pos + np.arange(len(frame)), "header": header}.items()):
            frame.insert(k, column, values)
        return frame, pos + len(frame), names[-1]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, pos, last, due = self._state()
        held = _frame([tuple(x) for x in self.held.get()] if self.held.exists() else [])
        for frame in rows:
            frame = _typed(frame.sort_values(["arrival", "file", "generation", "start_byte"], kind="stable")[FIELDS])
            held = pd.concat([held, frame], ignore_index=True) if len(held) else frame
            if full := len(held) // self.most:
                out, pos, last = self._batches(held.iloc[: full * self.most], number, pos, last)
                held, number = held.iloc[full * self.most :], number + full
                if due:
                    self.handle.deleteTimer(due)
                    due = 0
                yield out
        if len(held) and not due:
            due = timerValues.getCurrentProcessingTimeInMs() + self.window
            self.handle.registerTimer(due)
        self.held.clear()
        if len(held):
            self.held.put(_tuples(held))
        self.at.update((number, pos, last, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, pos, last, due = self._state()
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        if held and due <= expiredTimerInfo.getExpiryTimeInMs():
            out, pos, last = self._batch(held, number, pos, last)
            self.held.clear()
            self.at.update((number + 1, pos, last, 0))
            yield out


def arriving_batches(lines: DataFrame, by: Column | None = None, most_lines: int = 1000, window_ms: int = 250, headers: str = "swap") -> DataFrame:
    """A stream of decoded lines (``LINE``, generation, start_byte) in batches; with ``by``, each key by itself (column ``lane``)."""
    configure_state(lines.sparkSession)
    keyed = lines.select((F.lit("") if by is None else by.cast("string")).alias("lane"), *FIELDS, "generation", "start_byte")
    out = keyed.groupBy("lane").transformWithStateInPandas(Batches(most_lines, window_ms, headers), OUT, "Append", "ProcessingTime")
    return out
