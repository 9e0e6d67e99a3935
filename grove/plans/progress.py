"""Counts that rise while a phase runs.

Tasks add to accumulators as they finish; a thread at the driver reads them
every tenth of a second and says what has changed.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import Accumulator, SparkContext

#: Seconds between two readings: fixed.
EVERY = 0.1


class Meter:
    """Counts by name, told as they rise; tell hears a name and its count, from a thread of its own."""

    def __init__(self, context: SparkContext, tell: Callable[[str, int], None], every: float = EVERY):
        self.context, self.tell, self.every = context, tell, every
        self.counts: dict[str, Accumulator] = {}

    def count(self, name: str) -> Accumulator:
        """The accumulator of a name, for tasks to add to."""
        return self.counts.setdefault(name, self.context.accumulator(0))

    @contextmanager
    def running(self) -> Iterator[Meter]:
        """Reads the counts while the block runs, and once more when it has ended, also by an error."""
        stop, told = threading.Event(), {}

        def read() -> None:
            for name, count in list(self.counts.items()):
                if count.value != told.get(name, 0):
                    told[name] = count.value
                    self.tell(name, told[name])

        def watch() -> None:
            while not stop.wait(self.every):
                read()

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield self
        finally:
            stop.set()
            thread.join()
            read()
