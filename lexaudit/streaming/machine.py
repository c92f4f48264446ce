"""The protocol of runs as a state machine with typed, keyed state over a stream of events.

State of a run is one typed value (``_RUN``) and a map of blocks, each the events of a span of sequence numbers. A
block of more than ``HELD`` events is cut in pieces, so a run has as many blocks as its events need, however far
apart their numbers are; the value has the blocks' first numbers. A micro-batch reads and writes the value and the
blocks that its events touch, nothing else. Events may come in any order, late within the watermark, and more than once: the state follows
from the set of (run, seq), of equal ones the first to come counts. When an end comes before an end that
came earlier, the first event behind it is looked up in the map.

An open run without events for ``stall_ms`` of event time is reported as stalled and may go on; ``keep_ms``
after that, or after the last event of an ended run, its state goes. In processing-time mode (``ttl_ms``)
blocks expire by themselves instead, and nothing stalls."""

from __future__ import annotations

import contextlib
import sys
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lexaudit.streaming.stages import is_terminal

HELD = 4096
STATES = "run_id string, version long, n_events long, state string, first_bad_seq long"
_RUN = "n long, end_seq long, failed boolean, after long, invalid long, version long, timer long, stalled boolean, firsts binary"
_SEEN, _END, _ERROR, _INVALID = 1, 2, 4, 8
_LEAST = np.array([np.iinfo(np.int64).min])


class RunMachine(StatefulProcessor):
    """Folds events of a run into its state; a row goes out whenever new ones have come."""

    def __init__(self, stall_ms: int, keep_ms: int, ttl_ms: int | None):
        self.stall_ms, self.keep_ms, self.ttl_ms = stall_ms, keep_ms, ttl_ms

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _RUN)
        self.seen = handle.getMapState("seen", "block long", "flags binary", self.ttl_ms)

    def _block(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """Sequence numbers, ascending, and flags of a block's events."""
        there = self.ttl_ms is None or self.seen.containsKey((first,))  # blocks that the value names may have expired
        found = self.seen.getValue((first,)) if there else None
        raw = b"" if found is None else zlib.decompress(bytes(found[0]))
        n = len(raw) // 9
        return np.cumsum(np.frombuffer(raw, np.int64, n)), np.frombuffer(raw, np.uint8, n, 8 * n)

    def _put(self, first: int, seqs: np.ndarray, flags: np.ndarray) -> None:
        self.seen.updateValue((first,), (zlib.compress(np.diff(seqs, prepend=0).tobytes() + flags.tobytes(), 1),))

    @staticmethod
    def _firsts(run: dict) -> np.ndarray:
        """Where each block's span begins, ascending; none before the first event."""
        return np.frombuffer(bytes(run["firsts"] or b""), np.int64)

    def _next(self, run: dict, seq: int) -> int | None:
        """The least sequence number seen after ``seq``."""
        firsts = self._firsts(run)
        for first in firsts[max(0, int(np.searchsorted(firsts, seq, "right")) - 1) :].tolist():
            seqs, _ = self._block(first)
            if len(at := seqs[seqs > seq]):
                return int(at[0])
        return None

    def _fold(self, run: dict, seqs: np.ndarray, flags: np.ndarray) -> bool:
        """Whether events are new; the value and the blocks then have them."""
        _, first = np.unique(seqs, return_index=True)
        seqs, flags = seqs[first], flags[first]
        new = np.zeros(len(seqs), bool)
        firsts = self._firsts(run)
        begun = len(firsts) > 0
        firsts = firsts if begun else _LEAST
        span, cuts = np.searchsorted(firsts, seqs, "right") - 1, []
        for i in np.unique(span).tolist():
            mine = np.flatnonzero(span == i)
            known, had = self._block(int(firsts[i])) if begun else (seqs[:0], flags[:0])
            fresh = mine[~np.isin(seqs[mine], known)]
            if not len(fresh):
                continue
            new[fresh] = True
            merged = np.concatenate([known, seqs[fresh]])
            order = np.argsort(merged, kind="stable")
            merged, marks = merged[order], np.concatenate([had, flags[fresh]])[order]
            pieces = [0, *(range(HELD // 2, len(merged) - HELD // 4, HELD // 2) if len(merged) > HELD else ()), len(merged)]
            for a, b in zip(pieces, pieces[1:], strict=False):
                self._put(int(merged[a] if a else firsts[i]), merged[a:b], marks[a:b])
            cuts += merged[pieces[1:-1]].tolist()
        if cuts or not begun:
            run["firsts"] = np.sort(np.concatenate([firsts, np.array(cuts, np.int64)])).tobytes()
        seqs, flags = seqs[new], flags[new]
        if not len(seqs):
            return False
        run["n"] += len(seqs)
        least = lambda *v: min((int(x) for x in v if x is not None), default=None)
        run["invalid"] = least(run["invalid"], *seqs[flags & _INVALID > 0][:1])
        ends = np.flatnonzero(flags & _END)
        if len(ends) and (run["end_seq"] is None or seqs[ends[0]] < run["end_seq"]):
            run["end_seq"], run["failed"] = int(seqs[ends[0]]), bool(flags[ends[0]] & _ERROR)
            run["after"] = self._next(run, run["end_seq"])
        elif run["end_seq"] is not None:
            run["after"] = least(run["after"], *seqs[seqs > run["end_seq"]][:1])
        return True

    def _load(self) -> dict:
        names = [f.split()[0] for f in _RUN.split(", ")]
        return dict(zip(names, self.run.get() if self.run.exists() else (0, None, False, None, None, 0, None, False, None), strict=True))

    @staticmethod
    def _state(run: dict) -> tuple[str, int | None]:
        bad = min((x for x in (run["after"], run["invalid"]) if x is not None), default=None)
        name = "protocol_error" if bad is not None else "open" if run["end_seq"] is None else "failed" if run["failed"] else "complete"
        return ("stalled" if name == "open" and run["stalled"] else name), bad

    def _row(self, key: tuple, run: dict) -> pd.DataFrame:
        name, bad = self._state(run)
        return pd.DataFrame({"run_id": [key[0]], "version": [run["version"]], "n_events": [run["n"]], "state": [name], "first_bad_seq": pd.array([bad], "Int64")})

    def _rearm(self, run: dict, at: int) -> None:
        if self.ttl_ms is None and at != run["timer"]:
            if run["timer"] is not None:
                self.handle.deleteTimer(run["timer"])
            self.handle.registerTimer(at)
            run["timer"] = at

    def _take(self, run: dict, events: pd.DataFrame) -> bool:
        return self._fold(run, events["seq"].to_numpy(np.int64), events["flags"].to_numpy(np.uint8))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        run, changed, last = self._load(), False, None
        for events in rows:
            changed |= self._take(run, events)
            if self.ttl_ms is None:
                own = int(events["at_ms"].max())
                last = own if last is None else max(last, own)
        if not changed:
            return
        run["version"], run["stalled"] = run["version"] + 1, False
        if last is not None:
            wait = self.stall_ms if self._state(run)[0] == "open" else self.keep_ms
            self._rearm(run, max(last, timerValues.getCurrentWatermarkInMs(), (run["timer"] or 0) - wait) + wait)
        self.run.update(tuple(run.values()))
        yield self._row(key, run)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        run = self._load()
        if self._state(run)[0] != "open":
            self.run.clear()
            self.seen.clear()
            return
        run["version"], run["stalled"], run["timer"] = run["version"] + 1, True, None
        self._rearm(run, expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        self.run.update(tuple(run.values()))
        yield self._row(key, run)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        run = self._load()
        if self._take(run, initialState):
            run["version"] += 1
            self.run.update(tuple(run.values()))


def _flagged(events: DataFrame) -> DataFrame:
    ok = F.coalesce("valid", F.lit(True)) if "valid" in events.columns else F.lit(True)
    end = F.coalesce(is_terminal(F.col("stage"), F.col("status")), F.lit(False))
    flags = F.lit(_SEEN) + F.when(end, F.lit(_END) + F.when(F.col("stage") == "error", _ERROR).otherwise(0)).otherwise(0) + F.when(ok, 0).otherwise(_INVALID)
    return events.withColumn("flags", flags.cast("int"))


def machine_states(
    events: DataFrame, lateness: str = "10 minutes", stall_ms: int = 600_000, keep_ms: int = 3_600_000, ttl_ms: int | None = None, before: DataFrame | None = None
) -> DataFrame:
    """Updates of run states (``STATES``) of a stream of run_id, seq, stage, status, ts and maybe valid.

    ``version`` numbers the updates of a run, from 1; events of ``before`` (a batch table) are taken as seen
    before the stream began and count for runs that go on. Start the query inside ``state_store``."""
    columns = ["run_id", "seq", "flags"]
    flagged = _flagged(events)
    if ttl_ms is None:
        flagged = flagged.withWatermark("ts", lateness).withColumn("at_ms", F.unix_millis("ts"))
        columns += ["at_ms", "ts"]
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the process that sets the states up gets no shipped code
    past = None if before is None else _flagged(before).select("run_id", "seq", "flags").groupBy("run_id")
    mode = "EventTime" if ttl_ms is None else "ProcessingTime"
    return flagged.select(*columns).groupBy("run_id").transformWithStateInPandas(RunMachine(stall_ms, keep_ms, ttl_ms), STATES, "Append", mode, past)


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed map and timer state need, for queries started inside; the setting is put back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


def latest_states(updates: DataFrame) -> DataFrame:
    """The last update of each run."""
    last = updates.groupBy("run_id").agg(F.max(F.struct("version", "n_events", "state", "first_bad_seq")).alias("u"))
    return last.select("run_id", "u.n_events", "u.state", "u.first_bad_seq")
