"""Progress of running queries as events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming.listener import StreamingQueryListener

from clusterloom.operators.sinks import event


class Progress(StreamingQueryListener):
    """Sends a status event for each micro-batch, then done or error; the first line is sent before any result."""

    def __init__(self, send: Callable[[str], None], total: int | None = None) -> None:
        self.send, self.total, self.fetched = send, total, 0

    def onQueryStarted(self, event_) -> None:
        self.send(event("status", message="started"))

    def onQueryProgress(self, event_) -> None:
        self.fetched += event_.progress.numInputRows
        self.send(event("status", message=f"{self.fetched} rows", fetched=self.fetched, total=self.total))

    def onQueryIdle(self, event_) -> None:
        pass

    def onQueryTerminated(self, event_) -> None:
        self.send(event("error", message=event_.exception) if event_.exception else event("done", result=str(self.fetched)))
