"""Keyed state of the streams: event-time order, small states and paged queues.

``OrderedProcessor`` is the base of all folds over single events. New rows of a key are
appended to a list state, which is not read then; a timer at the first of them fires once
the watermark has passed it. Only then the list is read, its ready rows are handled in event time
and the rest is kept. What a fold remembers is a value state of its own, and a sliding
window is a ``Queue``: pages of a map state with a head and a tail, where a row costs one
entry when it comes and one when it leaves, however long the window is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGE = 128

Row = tuple[int, int, int]
Step = Callable[[list[int], int, int, int], tuple[list[int], tuple | None]]


class Queue:
    """Entries (time, value) between a head and a tail, in pages of a map state.

    Pages read or changed while one key is worked on are held and written once; pages
    that all heads have passed are removed.
    """

    def __init__(self, state):
        self.state = state
        self.pages: dict[int, list[list[int]]] = {}
        self.changed: set[int] = set()

    def page(self, number: int) -> list[list[int]]:
        if number not in self.pages:
            found = self.state.getValue((number,))
            self.pages[number] = [list(found[0]), list(found[1])] if found else [[], []]
        return self.pages[number]

    def get(self, at: int) -> tuple[int, int]:
        times, values = self.page(at // PAGE)
        return times[at % PAGE], values[at % PAGE]

    def append(self, at: int, time: int, value: int) -> None:
        times, values = self.page(at // PAGE)
        times.append(time)
        values.append(value)
        self.changed.add(at // PAGE)

    def flush(self, was: int, head: int) -> None:
        """Write what changed; entries from ``was`` up to ``head`` have left."""
        for number in range(was // PAGE, head // PAGE):
            if number not in self.changed or self.state.containsKey((number,)):
                self.state.removeKey((number,))
        for number in self.changed:
            if number >= head // PAGE:
                times, values = self.pages[number]
                self.state.updateValue((number,), (times, values))


QUEUE_KEY = T.StructType([T.StructField("page", T.LongType())])
LONGS = T.ArrayType(T.LongType())
QUEUE_VALUE = T.StructType([T.StructField("times", LONGS), T.StructField("entries", LONGS)])
WAITING = T.StructType([T.StructField(n, T.LongType()) for n in ("us", "id", "v")])
MEMO = T.StructType([T.StructField("memo", LONGS), T.StructField("seen", T.LongType()), T.StructField("due", T.LongType())])


class OrderedProcessor(StatefulProcessor):
    """Rows (row_us, row_id, row_value) of a key in event time, equal times together.

    ``columns``: the result's, the keys first. With ``ttl`` a key without news for that many
    seconds is forgotten. A key has one timer: at its first waiting row, or at its end of life.
    """

    def __init__(self, columns: Sequence[str], ttl: int | None):
        self.columns, self.ttl = list(columns), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.memory = handle.getValueState("memo", MEMO)

    def advance(self, memo: list[int], ready: list[Row]) -> tuple[list[int], list[tuple]]:
        """The new memory, and the result's rows, for rows in order."""
        raise NotImplementedError

    def forget(self) -> None:
        """Called with a key's end of life, for state of the subclass."""

    def _load(self) -> tuple[list[int], int, int]:
        found = self.memory.get()
        return (list(found[0]), found[1], found[2]) if found else ([], 0, -1)

    def _later(self, memo: list[int], seen: int, at: int) -> None:
        self.handle.registerTimer(at)
        self.memory.update((memo, seen, at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        new: list[Row] = []
        for frame in rows:
            new += zip(frame["row_us"].tolist(), frame["row_id"].tolist(), frame["row_value"].tolist(), strict=True)
        if new:
            self.waiting.appendList(new)
            memo, seen, due = self._load()
            first = min(x[0] for x in new) // 1000 + 1
            if due < 0 or first < due:
                if due >= 0:
                    self.handle.deleteTimer(due)
                self.handle.registerTimer(first)
                self.memory.update((memo, seen, first))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        mark = timerValues.getCurrentWatermarkInMs()
        memo, seen, _ = self._load()
        rows = sorted((int(a), int(b), int(c)) for a, b, c in self.waiting.get())
        ready = [x for x in rows if x[0] <= mark * 1000]
        rest = rows[len(ready) :]
        made: list[tuple] = []
        if ready:
            memo, made = self.advance(memo, ready)
            seen = ready[-1][0]
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        end = None if self.ttl is None else seen // 1000 + self.ttl * 1000
        if rest:
            self._later(memo, seen, max(rest[0][0] // 1000 + 1, mark + 1))
        elif end is not None and end <= mark:
            self.memory.clear()
            self.forget()
        elif end is not None:
            self._later(memo, seen, end)
        else:
            self.memory.update((memo, seen, -1))
        yield pd.DataFrame([(*key, *m) for m in made], columns=self.columns)

    def close(self) -> None:
        pass


class FoldProcessor(OrderedProcessor):
    """A fold whose memory is a few whole numbers: ``step(memo, time, id, value)``."""

    def __init__(self, columns: Sequence[str], ttl: int | None, step: Step):
        super().__init__(columns, ttl)
        self.step = step

    def advance(self, memo, ready):
        made = []
        for t, i, v in ready:
            memo, out = self.step(memo, t, i, v)
            if out is not None:
                made.append((i, t, *out))
        return memo, made


class RulesProcessor(OrderedProcessor):
    """Correlation of entities by several rules at once; the last key but one is the kind of entity.

    ``kinds``: per kind its rules (id, span, the needs of its stages, its first bit). One queue holds the
    signals of the longest span; every rule has a head in it, running counts of its
    stages, of signals that match any, and whether the last signal was a hit.
    """

    def __init__(self, columns: Sequence[str], ttl: int, kinds: dict[str, list[tuple[str, int, tuple[int, ...], int]]]):
        super().__init__(columns, ttl)
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.log = handle.getMapState("log", QUEUE_KEY, QUEUE_VALUE)

    def forget(self) -> None:
        self.log.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802,N803
        self.rules = self.kinds[key[-2]]
        yield from super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def advance(self, memo, ready):
        rules, queue, made = self.rules, Queue(self.log), []
        memo = memo or [0, 0]
        tail, last, at = memo[0], memo[1], 2
        marks = []  # per rule: head, hit before, matched, counts of stages
        for _, _, needs, _ in rules:
            width = 3 + len(needs)
            marks.append(memo[at : at + width] if len(memo) > at else [0] * width)
            at += width
        was = min(m[0] for m in marks)
        i = 0
        while i < len(ready):
            t, j = ready[i][0], i
            while j < len(ready) and ready[j][0] == t:  # signals of one time see each other
                queue.append(tail, t, ready[j][2])
                tail, j = tail + 1, j + 1
            for (name, span, needs, bit), m in zip(rules, marks, strict=True):
                mask = (1 << len(needs)) - 1
                for _, _, v in ready[i:j]:
                    self._count(m, v >> bit & mask, 1, len(needs))
                while True:
                    left, v = queue.get(m[0])
                    if left >= t - span:
                        break
                    self._count(m, v >> bit & mask, -1, len(needs))
                    m[0] += 1
                hit = all(n >= k for n, k in zip(m[3:], needs, strict=True))
                if hit and not (m[1] and t - last <= span):
                    made.append((ready[i][1], t, name, tail - m[0], m[2], queue.get(m[0])[0]))
                m[1] = int(hit)
            last, i = t, j
        queue.flush(was, min(m[0] for m in marks))
        return [tail, last, *[x for m in marks for x in m]], made

    @staticmethod
    def _count(m: list[int], bits: int, sign: int, stages: int) -> None:
        if bits:
            m[2] += sign
            for k in range(stages):
                if bits >> k & 1:
                    m[3 + k] += sign


class DetectorProcessor(StatefulProcessor):
    """z of closed bins against the window before, and EWMA z; bins come in order.

    The window's counts are a queue with a running sum and sum of squares.
    """

    def __init__(self, columns: Sequence[str], window: int, alpha: float, least: float):
        self.columns, self.window, self.alpha, self.least = list(columns), window, alpha, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        number = lambda n, k: T.StructField(n, k)
        self.memory = handle.getValueState(
            "memo",
            T.StructType([number(n, T.LongType()) for n in ("head", "tail", "s", "q", "last")] + [number(n, T.DoubleType()) for n in ("m", "v")]),
        )
        self.log = handle.getMapState("log", QUEUE_KEY, QUEUE_VALUE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803
        frame = pd.concat(list(rows)).sort_values("bin")
        head, tail, s, q, last, m, v = self.memory.get() or (0, 0, 0, 0, None, 0.0, 0.0)
        queue, was, made = Queue(self.log), head, []
        a, r, w = self.alpha, 1.0 - self.alpha, self.window
        for b, c in zip(frame["bin"].tolist(), frame["c"].tolist(), strict=True):
            while head < tail:
                old, n = queue.get(head)
                if old >= b - w:
                    break
                s, q, head = s - n, q - n * n, head + 1
            spread = w * q - s * s
            mean, std = s / w, (spread / (w * (w - 1))) ** 0.5
            z = (c - mean) / std if spread > 0 else 0.0
            if last is None:
                m, v, ew = float(c), 0.0, 0.0
            else:
                gap = b - last - 1
                if gap > 0:  # closed form of bins without events
                    p = r**gap
                    m, v = p * m, p * v + m * m * p * (1.0 - p)
                d = c - m
                m, v = a * c + r * m, r * (v + a * d * d)
                sd = v**0.5
                ew = (c - m) / sd if sd > self.least else 0.0
            queue.append(tail, b, c)
            s, q, tail, last = s + c, q + c * c, tail + 1, b
            made.append((*key, b, c, mean, std, z, ew))
        queue.flush(was, head)
        self.memory.update((head, tail, s, q, last, m, v))
        yield pd.DataFrame(made, columns=self.columns)

    def close(self) -> None:
        pass
