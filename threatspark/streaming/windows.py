"""State of trailing windows, kept in buckets of time.

A window's entries lie in map state, one value for each bucket, and a value state holds running totals and how far the oldest
entries have been taken back. An entry is written once with its bucket and read once more when it leaves, so a row costs the same
however full the window is, and a batch rewrites the buckets that it touches and nothing else.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql.streaming import StatefulProcessorHandle

#: Buckets in a window's width.
BUCKETS = 32


class TrailingWindow:
    """Entries ``(time, text)`` of the closed window ``[t - width, t]`` of the newest row.

    Rows come in order of time inside a batch. A row that an earlier batch has overtaken is put in its place if the window
    still reaches it, and otherwise no longer counts for later rows.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, width_us: int | None) -> None:
        self.width = width_us
        self.size = None if width_us is None else max(1, -(-width_us // BUCKETS))
        self.buckets = handle.getMapState(f"{name}_buckets", "bucket long", "entries string")
        self.head = handle.getValueState(f"{name}_head", "first long, taken long, last long, newest long, alive long, totals string")

    def begin(self) -> None:
        """Read the head; buckets are read when they are needed."""
        first, taken, last, newest, alive, totals = tuple(self.head.get()) if self.head.exists() else (None, 0, None, None, 0, "{}")
        #: Oldest bucket, entries of it that have left, newest bucket, newest time, entries that have not left, and totals.
        self.first, self.taken, self.last, self.newest, self.alive, self.totals = first, taken, last, newest, alive, json.loads(totals)
        self.loaded: dict[int, list] = {}
        self.changed: set[int] = set()

    def finish(self) -> None:
        for b in self.changed:
            entries = self.loaded[b]
            if entries:
                self.buckets.updateValue((b,), (json.dumps(entries),))
            elif self.buckets.containsKey((b,)):
                self.buckets.removeKey((b,))
        self.head.update((self.first, self.taken, self.last, self.newest, self.alive, json.dumps(self.totals)))

    def clear(self) -> None:
        self.buckets.clear()
        self.head.clear()

    def _bucket(self, b: int) -> list:
        if b not in self.loaded:
            found = self.buckets.getValue((b,)) if self.buckets.containsKey((b,)) else None
            self.loaded[b] = json.loads(found[0]) if found is not None else []
        return self.loaded[b]

    def put(self, t: int, text: str) -> bool:
        """Add an entry; False if it is older than what has already left."""
        b = t // self.size
        if self.first is None:
            self.first = self.last = b
        if b < self.first:
            if self.newest is not None and t < self.newest - self.width:
                return False
            self.first, self.taken = b, 0
        entries = self._bucket(b)
        at = bisect_right(entries, t, key=lambda e: e[0])
        if b == self.first and at < self.taken:
            return False
        entries.insert(at, [t, text])
        self.changed.add(b)
        self.alive += 1
        self.last = max(self.last, b)
        self.newest = t if self.newest is None else max(self.newest, t)
        return True

    def leave(self, oldest: int) -> Iterator[tuple[int, str]]:
        """Entries before ``oldest`` that have not left yet, oldest first. When none is left the window starts anew."""
        while self.first is not None:
            entries = self._bucket(self.first)
            while self.taken < len(entries) and entries[self.taken][0] < oldest:
                yield tuple(entries[self.taken])
                self.taken += 1
                self.alive -= 1
            if self.taken < len(entries) or (self.alive and self.first >= oldest // self.size):
                return
            entries.clear()
            self.changed.add(self.first)
            self.taken = 0
            self.first = self.first + 1 if self.alive else None


class TrailingCounts(TrailingWindow):
    """Rows of each kind in the window, as running totals."""

    def add(self, t: int, kind: str) -> dict[str, int]:
        if self.newest is not None and t < self.newest:
            return self._overtaken(t, kind)
        for _, left in self.leave(t - self.width):
            self.totals[left] -= 1
        self.put(t, kind)
        self.totals[kind] = self.totals.get(kind, 0) + 1
        return {k: n for k, n in self.totals.items() if n}

    def _overtaken(self, t: int, kind: str) -> dict[str, int]:
        """Counts of a row that came after newer ones: those that are still known in its own window."""
        if self.put(t, kind) and t >= self.newest - self.width:
            self.totals[kind] = self.totals.get(kind, 0) + 1
        counts = {kind: 0}
        for b in range(max(self.first, (t - self.width) // self.size), t // self.size + 1):
            for at, k in self._bucket(b):
                if t - self.width <= at <= t:
                    counts[k] = counts.get(k, 0) + 1
        counts[kind] = max(1, counts[kind])
        return counts


class TrailingDistinct(TrailingWindow):
    """Different values that a key has met: ever, or, with a width, within that time.

    Map state holds when each value was last met; a batch reads a value once and writes it once, at its end. An entry that leaves the
    window takes its value along only if the value has not been met since.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, width_us: int | None) -> None:
        self.met = handle.getMapState(f"{name}_met", "value string", "last long")
        if width_us is None:
            self.width = None
            self.count = handle.getValueState(f"{name}_count", "n long")
        else:
            super().__init__(handle, name, width_us)

    def begin(self) -> None:
        #: Values of this batch: when they were last met before it, and now. None: not met.
        self.before: dict[str, int | None] = {}
        self.lasts: dict[str, int | None] = {}
        if self.width is None:
            self.n = self.count.get()[0] if self.count.exists() else 0
        else:
            super().begin()

    def finish(self) -> None:
        for value, last in self.lasts.items():
            if last is None and self.before[value] is not None:
                self.met.removeKey((value,))
            elif last is not None and last != self.before[value]:
                self.met.updateValue((value,), (last,))
        if self.width is None:
            self.count.update((self.n,))
        else:
            super().finish()

    def _last(self, value: str) -> int | None:
        """When a value was last met."""
        if value not in self.lasts:
            known = self.met.containsKey((value,))
            self.before[value] = self.lasts[value] = self.met.getValue((value,))[0] if known else None
        return self.lasts[value]

    def add(self, t: int, value: str) -> int:
        """Different values, this one included."""
        if self.width is None:
            if self._last(value) is None:
                self.lasts[value] = t
                self.n += 1
            return self.n
        self.expire(t - self.width)
        last = self._last(value)
        if last is None:
            self.totals["n"] = self.totals.get("n", 0) + 1
        if last is None or last < t:
            self.lasts[value] = t
        self.put(t, value)
        return self.totals["n"]

    def expire(self, oldest: int) -> int:
        """Take back what was last met before ``oldest``; the values that remain."""
        for at, value in self.leave(oldest):
            last = self._last(value)
            if last is not None and last <= at:
                self.lasts[value] = None
                self.totals["n"] -= 1
        return self.totals.get("n", 0)
