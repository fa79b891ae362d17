"""Row-by-row enumeration of results; event-time streams are not part of the graph surface."""

from __future__ import annotations

import threading
import uuid
from collections.abc import AsyncIterator, Callable, Iterator

from pyspark import InheritableThread
from pyspark.sql import Row, SparkSession

from ..errors import CancelledError


def rows(query, prefetch: bool = True) -> Iterator[Row]:
    """A query's rows, one partition on the driver at a time; ``prefetch`` fetches the next meanwhile."""
    return query.to_df().toLocalIterator(prefetchPartitions=prefetch)


async def rows_async(query) -> AsyncIterator[Row]:
    """The same for ``async for``; each row is fetched outside the event loop's thread."""
    import asyncio

    source, end = rows(query), object()
    while (row := await asyncio.to_thread(next, source, end)) is not end:
        yield row


class Cancellation:
    """A token that ends the Spark jobs of what runs under it: a job group of its own.

    ``run`` calls a function in a thread of that group; ``cancel``, from any other
    thread, ends its jobs, after which ``run`` raises ``CancelledError``.
    """

    def __init__(self, spark: SparkSession):
        self._sc, self._group, self._asked = spark.sparkContext, f"graphloom-{uuid.uuid4().hex}", threading.Event()

    @property
    def cancelled(self) -> bool:
        return self._asked.is_set()

    def cancel(self) -> None:
        self._asked.set()
        self._sc.cancelJobGroup(self._group)

    def run(self, work: Callable[[], object]):
        out: dict = {}

        def body():
            self._sc.setJobGroup(self._group, "graphloom query", interruptOnCancel=True)
            try:
                out["value"] = work()
            except Exception as e:  # handed to the caller's thread
                out["error"] = e

        if self.cancelled:
            raise CancelledError("cancelled before it began")
        thread = InheritableThread(target=body)
        thread.start()
        thread.join()
        if self.cancelled:
            raise CancelledError("cancelled") from out.get("error")
        if "error" in out:
            raise out["error"]
        return out["value"]
