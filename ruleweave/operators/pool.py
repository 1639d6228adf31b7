"""A fixed number of sessions of one knowledge base, for threads of a driver that share its Spark session."""

from __future__ import annotations

import queue
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .session import KnowledgeBase, Session


class SessionPool:
    """At most ``size`` sessions are out at a time; one that comes back is replaced by a fresh one."""

    def __init__(self, kb: KnowledgeBase, spark: SparkSession, size: int, **options):
        if size < 1:
            raise ValueError("a pool holds one session at least")
        self.kb, self.spark, self.options, self.size = kb, spark, options, size
        self._free: queue.Queue[Session] = queue.Queue()
        self._out: set[int] = set()
        for _ in range(size):
            self._free.put(self._fresh())

    def _fresh(self) -> Session:
        return Session(self.kb, self.spark, **self.options)

    def acquire(self, timeout: float | None = None) -> Session:
        """Waits for a session; TimeoutError after ``timeout`` seconds."""
        try:
            session = self._free.get(timeout=timeout)
        except queue.Empty:
            raise TimeoutError(f"all {self.size} sessions are out") from None
        self._out.add(id(session))
        return session

    def release(self, session: Session) -> None:
        """Facts, fired matches and globals of the session are gone for whoever comes next."""
        if id(session) not in self._out:
            raise ValueError("the session is not of this pool, or came back already")
        self._out.discard(id(session))
        self._free.put(self._fresh())

    @property
    def free(self) -> int:
        return self._free.qsize()

    @contextmanager
    def session(self, timeout: float | None = None) -> Iterator[Session]:
        found = self.acquire(timeout)
        try:
            yield found
        finally:
            self.release(found)
