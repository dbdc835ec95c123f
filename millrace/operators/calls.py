"""Bounded calls from tasks: permits that add up over the job, retries by due time, limits on the time of a call."""

from __future__ import annotations

import heapq
import threading
import time
from collections.abc import Callable, Generator
from typing import Any

from pyspark import TaskContext

# A row's steps: each yield asks for one call, or for a pause in seconds; the value returned is the row's result.
Steps = Generator[Callable[[], Any] | float, Any, Any]


class CallTimeout(Exception):
    """A call took longer than its limit; whatever it gives later is not looked at."""


def task_permits(concurrency: int, tasks: int) -> int:
    """This task's share of the job's permits, of which task 0 to tasks - 1 hold `concurrency` together."""
    context = TaskContext.get()
    place = context.partitionId() if context else 0
    return max(1, concurrency // tasks + (place < concurrency % tasks))


def run_by_due_time(
    rows: list[Steps], permits: int, sleep: Callable[[float], None], limit: float | None = None
) -> list[Any]:
    """Results of all rows, in order, with at most `permits` calls at once.

    Waiting rows lie in a heap by due time, so a row that pauses holds no permit.  A call over `limit` seconds ends for
    its row with CallTimeout, but keeps its permit until it comes back.  An error of a call is thrown into its row.
    `sleep` may return early; the time it was asked for then counts as passed.
    """
    line = _Line(rows, sleep)
    workers = [threading.Thread(target=line.work, daemon=True) for _ in range(min(permits, len(rows)))]
    for worker in workers:
        worker.start()
    line.watch(limit)
    for worker in workers:
        worker.join()
    if line.broken is not None:
        raise line.broken
    return line.results


class _Line:
    """Rows in a heap by due time, and workers that take them: a worker is a permit and makes its calls itself.

    Handing single calls to a pool would cost many times what a quick call takes.
    """

    def __init__(self, rows: list[Steps], sleep: Callable[[float], None]):
        self.rows, self.sleep = rows, sleep
        self.results: list[Any] = [None] * len(rows)
        self.due = [(0.0, k) for k in range(len(rows))]
        self.asked: dict[int, Callable[[], Any]] = {}  # calls of rows in the heap that ended late and ask again
        self.calls: dict[object, tuple[int, float]] = {}  # row and start of each call that is not late
        self.open, self.busy, self.ahead = len(rows), 0, 0.0
        self.lock = threading.Lock()
        self.changed, self.over = threading.Condition(self.lock), threading.Condition(self.lock)
        self.broken: BaseException | None = None

    def work(self) -> None:
        with self.lock:
            try:
                while (k := self._next()) is not None:
                    asked = self.asked.pop(k, None) or self._advance(k)
                    while asked is not None:
                        asked = self._call(k, asked)
            except BaseException as error:  # the caller raises it
                self._break(error)

    def watch(self, limit: float | None) -> None:
        """Ends calls over the limit for their rows, until all rows are done."""
        with self.lock:
            while self.open and self.broken is None:
                rest = None
                if limit is not None:
                    now = time.monotonic()
                    for call in [c for c, (_, start) in self.calls.items() if now - start >= limit]:
                        self._end_late(self.calls.pop(call)[0], limit)
                    rest = min((start for _, start in self.calls.values()), default=now) + limit - now
                if self.open and self.broken is None:
                    self.over.wait(rest)

    def _now(self) -> float:
        return time.monotonic() + self.ahead

    def _break(self, error: BaseException) -> None:
        self.broken = self.broken or error
        self.changed.notify_all()
        self.over.notify_all()

    def _next(self) -> int | None:
        """A row that is due, as soon as there is one; None at the end."""
        while self.open and self.broken is None:
            pause = self.due[0][0] - self._now() if self.due else None
            if pause is not None and pause <= 0:
                return heapq.heappop(self.due)[1]
            if pause is None or self.busy:
                self.changed.wait(pause)
                continue
            self.busy += 1
            start = time.monotonic()
            self.lock.release()
            try:
                self.sleep(pause)
            finally:
                self.lock.acquire()
                self.busy -= 1
            self.ahead += max(0.0, pause - (time.monotonic() - start))
            self.changed.notify_all()
        return None

    def _advance(self, k: int, value: Any = None, error: BaseException | None = None) -> Callable[[], Any] | None:
        """The call that a row asks for, None when it pauses or ends."""
        try:
            asked = self.rows[k].throw(error) if error else self.rows[k].send(value)
        except StopIteration as end:
            self.results[k] = end.value
            self.open -= 1
            if not self.open:
                self.changed.notify_all()
                self.over.notify_all()
            return None
        if callable(asked):
            return asked
        heapq.heappush(self.due, (self._now() + asked, k))
        self.changed.notify()
        return None

    def _call(self, k: int, asked: Callable[[], Any]) -> Callable[[], Any] | None:
        """Makes a call and goes on with its row; of a late one nothing is looked at."""
        call, value, error = object(), None, None
        self.calls[call] = (k, time.monotonic())
        self.busy += 1
        self.lock.release()
        try:
            value = asked()
        except Exception as raised:
            error = raised
        finally:
            self.lock.acquire()
            self.busy -= 1
        if self.calls.pop(call, None) is None:
            self.changed.notify_all()
            return None
        return self._advance(k, value, error)

    def _end_late(self, k: int, limit: float) -> None:
        try:
            asked = self._advance(k, error=CallTimeout(f"{limit} s"))
        except BaseException as error:
            self._break(error)
            return
        if asked is not None:
            self.asked[k] = asked
            heapq.heappush(self.due, (self._now(), k))
            self.changed.notify()
