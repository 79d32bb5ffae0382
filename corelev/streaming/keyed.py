"""Per-key state on ``transformWithStateInPandas`` (S1, S2): value, list and map state on the RocksDB store, event-time timers.

A key's rows of a micro-batch are taken in (ord, id) order whatever their number: up to ``HOLD`` of them are
sorted in memory; beyond that, sorted runs go to the key's map state in parts of ``PART`` rows and are merged from
there, so a task holds about ``HOLD`` rows of a hot key at any time. The runs are gone when the batch ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor

HOLD = 100_000    # rows of one key sorted in memory
PART = 2_000      # rows of a part of a spilled run
RUNS = 40         # runs merged at once

ORDER = ["ord", "id"]


def _pack(pdf: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(pdf, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class SortedRows:
    """Frames in any order -> frames in (ord, id) order. ``spill``: a map state (run, part) -> rows."""

    def __init__(self, spill):
        self.spill, self.runs, self.next = spill, {}, 0  # runs: number -> parts

    def ordered(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in frames:
            if not len(f):
                continue
            held.append(f)
            n += len(f)
            if n >= HOLD:
                self._write([self._sorted(held)])
                held, n = [], 0
                if len(self.runs) == RUNS:
                    self._write(self._merge())
        if not self.runs:
            if n:
                yield self._sorted(held)
            return
        if n:
            self._write([self._sorted(held)])
        yield from self._merge()

    @staticmethod
    def _sorted(frames):
        rows = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        o, i = rows["ord"].to_numpy(), rows["id"].to_numpy()
        if bool(((o[1:] > o[:-1]) | ((o[1:] == o[:-1]) & (i[1:] >= i[:-1]))).all()):
            return rows
        return rows.sort_values(ORDER, kind="mergesort", ignore_index=True)

    def _write(self, frames) -> None:
        run, part, rest = self.next, 0, None
        self.next += 1
        for f in frames:
            for a in range(0, len(f), PART):
                self.spill.updateValue((run, part), (_pack(f.iloc[a:a + PART]),))
                part += 1
        self.runs[run] = part

    def _read(self, run, part) -> pd.DataFrame:
        rows = _unpack(self.spill.getValue((run, part))[0])
        self.spill.removeKey((run, part))
        return rows

    def _merge(self) -> Iterator[pd.DataFrame]:
        """All rows of the present runs in order; a run's next part is read when its last one is used up."""
        runs, self.runs = self.runs, {}
        at = dict.fromkeys(runs, 0)
        pool, tops = [], {}

        def load(run):
            rows = self._read(run, at[run])
            at[run] += 1
            pool.append(rows)
            tops[run] = (rows["ord"].iat[-1], rows["id"].iat[-1]) if at[run] < runs[run] else None

        for run in runs:
            load(run)
        while pool:
            rows = self._sorted(pool)
            open_ = [t for t in tops.values() if t is not None]
            if not open_:
                yield rows
                return
            o, i = min(open_)
            upto = int(((rows["ord"] < o) | ((rows["ord"] == o) & (rows["id"] <= i))).sum())
            yield rows.iloc[:upto]
            pool = [rows.iloc[upto:]] if upto < len(rows) else []
            for run in [r for r, t in tops.items() if t == (o, i)]:
                load(run)


class KeyedProcessor(StatefulProcessor):
    """Base: sorted rows of a key, and its state's end ``idle_ms`` after its last row (``time_col``; None: never)."""

    def __init__(self, idle_ms: int | None = None, time_col: str | None = None):
        self.idle_ms, self.time_col = idle_ms, time_col

    def init(self, handle) -> None:
        self.handle = handle
        self.spill = handle.getMapState("runs", "run int, part int", "rows binary")
        self.open(handle)

    def open(self, handle) -> None:
        raise NotImplementedError

    def clear(self) -> None:
        raise NotImplementedError

    def update(self, key, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):
        latest = [None]

        def seen(frames):
            for f in frames:
                if self.idle_ms is not None and len(f):
                    t = f[self.time_col].max()
                    latest[0] = t if latest[0] is None or t > latest[0] else latest[0]
                yield f

        yield from self.update(key, SortedRows(self.spill).ordered(seen(rows)))
        if latest[0] is not None:
            end = int(pd.Timestamp(latest[0]).timestamp() * 1000) + self.idle_ms
            for old in list(self.handle.listTimers()):
                end = max(end, old)
                self.handle.deleteTimer(old)
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.clear()
        return iter([])

    def close(self) -> None:
        pass


class OnlineLeverage(KeyedProcessor):
    """A key's Gram and row count; every row's online leverage against the rows up to it."""

    def __init__(self, d: int, method: str, **kw):
        super().__init__(**kw)
        self.d, self.method = d, method

    def open(self, handle) -> None:
        self.gram = handle.getValueState("gram", "g array<double>, n long")

    def clear(self) -> None:
        self.gram.clear()

    def update(self, key, frames):
        from corelev.operators.online import prefix_scores

        d = self.d
        g, n = self.gram.get() or (np.zeros(d * d), 0)
        P = np.asarray(g, dtype=float).reshape(d, d)
        for f in frames:
            X = np.stack(f["x"].to_numpy()).astype(float).reshape(-1, d)
            score = np.empty(len(X))
            step = max(64, 4_000_000 // (d * d + 64) // 64 * 64)
            for a in range(0, len(X), step):
                score[a:a + step], P = prefix_scores(P, X[a:a + step], self.method)
            n += len(X)
            yield pd.DataFrame({"key": [key[0]] * len(X), "id": f["id"].to_numpy(), "score": score})
        self.gram.update((P.ravel().tolist(), int(n)))


class ChaoReservoir(KeyedProcessor):
    """K slots (a list state), the weight sum and the rows seen; a slot keeps its last writer."""

    def __init__(self, k: int, **kw):
        super().__init__(**kw)
        self.k = k

    def open(self, handle) -> None:
        self.slots = handle.getListState("slots", "row string")
        self.sums = handle.getValueState("sums", "total double, seen long")

    def clear(self) -> None:
        self.slots.clear()
        self.sums.clear()

    def writers(self, f: pd.DataFrame):
        """[(row, slot)] of one frame in order; the sums go on."""
        k, w = self.k, f["weight"].to_numpy(float)
        upto = np.cumsum(np.r_[self.total, w])[1:]
        at = self.seen + np.arange(len(w))
        with np.errstate(divide="ignore", invalid="ignore"):
            chosen = (upto > 0) & (f["u1"].to_numpy() < k * w / np.where(upto > 0, upto, 1.0))
        slot = np.where(at < k, at, (f["u2"].to_numpy() * k).astype(np.int64) % k)
        self.total, self.seen = float(upto[-1]), int(self.seen + len(w))
        rows = np.flatnonzero((at < k) | chosen)
        return zip(rows.tolist(), slot[rows].tolist())

    def load(self) -> None:
        self.total, self.seen = self.sums.get() or (0.0, 0)

    def store(self) -> None:
        self.sums.update((float(self.total), int(self.seen)))

    def update(self, key, frames):
        self.load()
        slots = [r[0] for r in self.slots.get()] if self.seen else []
        for f in frames:
            text = f["held"].to_numpy()
            for i, s in self.writers(f):
                if s == len(slots):
                    slots.append(None)
                slots[s] = text[i]
        self.store()
        if slots:
            self.slots.put([(s,) for s in slots])
        yield pd.DataFrame({"key": [key[0]] * len(slots), "slot": np.arange(len(slots), dtype=np.int32), "held": slots})


class RidgeReservoir(ChaoReservoir):
    """S2, adaptive: a row's weight is its ridge leverage against the rows accepted so far (D7's rule per key).

    State besides the k slots: the d x d matrix of accepted rows, the weight sum and the rows seen.
    """

    def __init__(self, k: int, d: int, extra: float, lam: float, **kw):
        super().__init__(k, **kw)
        self.d, self.extra, self.lam = d, extra, lam

    def open(self, handle) -> None:
        super().open(handle)
        self.matrix = handle.getValueState("matrix", "a array<double>")

    def clear(self) -> None:
        super().clear()
        self.matrix.clear()

    def load(self) -> None:
        super().load()
        held = self.matrix.get()
        self.A = np.asarray(held[0], dtype=float).reshape(self.d, self.d) if held else self.lam * np.eye(self.d)

    def store(self) -> None:
        super().store()
        self.matrix.update((self.A.ravel().tolist(),))

    def writers(self, f: pd.DataFrame):
        from corelev.operators.sampling import ridge_accepts

        X = np.stack(f["x"].to_numpy()).astype(float).reshape(-1, self.d)
        taken, self.A, self.total, self.seen = ridge_accepts(
            self.A, self.total, self.seen, X, f["u1"].to_numpy(), f["u2"].to_numpy(), self.k, self.extra)
        return taken
