"""Stream operators with keyed state that ends: phase changes of builds, finished builds, agents that come and go.

Each takes a stream and gives a stream; ``scanlake.streaming`` runs them. A micro-batch reads and writes the state of the keys it
touches only (RocksDB, with changelogs in the checkpoint folder), and every state ends: builds without news after ``keep``, finished
builds after ``remember``, destroyed agents once the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scanlake.operators.rules import detect_phase
from scanlake.session import importable

DAY_MS = 24 * 3600 * 1000


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops chunks that repeat the phase of the chunks right before them.

    Only where chunks of one build follow each other without a gap, so that no other task can hold one in between. A build with
    most of the log lines sends its changes and one row for each gap to its state, not all of its lines.
    """
    for rows in batches:
        build, start, size = (np.asarray(rows.column(c)) for c in ("build", "offset", "size"))
        phase = rows.column("phase").dictionary_encode()
        code = np.asarray(phase.indices.fill_null(-1)).astype(np.int64)
        order = np.lexsort((start, build))
        build, start, size, code = build[order], start[order], size[order], code[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (build[1:] != build[:-1]) | (start[1:] != start[:-1] + size[:-1])
        place = np.arange(len(order))
        run = np.maximum.accumulate(np.where(fresh, place, 0))
        known = np.maximum.accumulate(np.where(code >= 0, place, -1))  # the last row with a phase, this one included
        before = np.concatenate(([-1], known[:-1]))
        same = (before >= run) & (code[np.maximum(before, 0)] == code)
        keep = order[(code >= 0) & ~same]
        yield rows.take(pa.array(keep)).select(["build", "offset", "phase", "ms", "seen"])


class _LastPhase(StatefulProcessor):
    """State: place and phase of the last chunk of a build that showed a phase, and when it may be forgotten."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "offset bigint, phase string, due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("offset", kind="stable")
        last = self.last.get() if self.last.exists() else None
        if last is not None:
            found = found[found["offset"] > last[0]]
        if not len(found):
            return
        due = int(found["ms"].max()) + self.keep_ms
        if last is not None:
            self.handle.deleteTimer(last[2])
        self.handle.registerTimer(due)
        before = found["phase"].shift(1, fill_value=last[1] if last is not None else "")
        self.last.update((int(found["offset"].iloc[-1]), str(found["phase"].iloc[-1]), due))
        changed = found[found["phase"] != before]
        if len(changed):
            yield changed[["build", "offset", "phase"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[2] <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def phase_changes(chunks: DataFrame, keep_ms: int = DAY_MS, size: Column | None = None, seen: Column | None = None, delay: str = "0 seconds") -> DataFrame:
    """Chunks (build, offset, phase) whose phase differs from the one seen before it in the build; ``chunks`` is (build, offset, text).

    ``size`` is what a chunk adds to the offset (1: chunks are numbered). Chunks of a build have to come in the order of their
    offsets from micro-batch to micro-batch; one at or before the last place that is known is a repetition and dropped. ``seen`` is the time
    of a chunk (those later than ``delay`` are dropped), that of its micro-batch if not given (a stream that is run for what is available would never end with timers of the
    clock). A build without news for ``keep_ms`` before the newest chunk is forgotten.
    """
    importable(chunks.sparkSession)
    detected = chunks.select(
        F.col("build").cast("bigint"), F.col("offset").cast("bigint"), (size if size is not None else F.lit(1)).cast("bigint").alias("size"), detect_phase("text").alias("phase"),
        (seen if seen is not None else F.current_timestamp()).alias("seen"),
    ).where("build is not null and offset is not null").withColumn("ms", F.unix_millis("seen"))
    sent = detected.mapInArrow(_without_repeats, "build bigint, offset bigint, phase string, ms bigint, seen timestamp").withWatermark("seen", delay)
    return sent.groupBy("build").transformWithStateInPandas(
        statefulProcessor=_LastPhase(keep_ms), outputStructType="build bigint, offset bigint, phase string", outputMode="Append", timeMode="EventTime"
    )


def finished_builds(builds: DataFrame, seen: str = "ts", remember: str = "7 days") -> DataFrame:
    """Each build once, when it is first seen finished (``building`` false).

    ``seen`` is the time of the report. A repeated report is dropped for ``remember`` at least after the newest one; then the
    build leaves the state. Reports older than the newest by more than ``remember`` are dropped.
    """
    done = builds.where(~F.col("building"))
    return done.withWatermark(seen, remember).dropDuplicatesWithinWatermark(["job", "number"])


class _Alive(StatefulProcessor):
    """State: time and action of the last event of an agent; that of a destroyed one ends with the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts bigint, action string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max((r for part in rows for r in zip(part["us"], part["action"])), default=None)
        known = tuple(self.last.get()) if self.last.exists() else None
        if newest is None or (known is not None and newest <= known):
            return
        newest = int(newest[0]), str(newest[1])
        self.last.update(newest)
        alive, before = newest[1] == "create", known is not None and known[1] == "create"
        if not alive:
            self.handle.registerTimer(newest[0] // 1000 + 1)
        if known is None or alive != before:
            yield pd.DataFrame({"pool": [key[0]], "agent": [key[1]], "us": [newest[0]], "change": [int(alive) - int(before)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            us, action = self.last.get()
            if action != "create" and us // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def agent_changes(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(pool, agent, us, change): 1 when an agent comes to life, -1 when it goes; 0 for one first seen destroyed.

    ``events`` is (pool, agent, ts, action) with action ``create`` or ``destroy``; at equal times a destruction comes last. Events
    later than ``delay`` are dropped. Only agents alive, and those destroyed within ``delay``, are in the state.
    """
    importable(events.sparkSession)
    rows = events.withWatermark("ts", delay).select("pool", "agent", "ts", F.unix_micros("ts").alias("us"), "action")
    return rows.groupBy("pool", "agent").transformWithStateInPandas(
        statefulProcessor=_Alive(), outputStructType="pool string, agent string, us bigint, change int", outputMode="Append", timeMode="EventTime"
    )
