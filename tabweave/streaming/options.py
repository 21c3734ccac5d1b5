"""Subscribe options: checked values for two kinds of backend, a partitioned log and a field stream."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from tabweave.plans.errors import InvalidArgument

#: The largest share-group delivery limit of a log.
MOST_SHARE_ATTEMPTS = 4
_LOG = ("max_retries", "share_attempts", "start_offset")
_STREAM = ("queue_depth", "pending_idle_s", "redeliver_s", "ack_batch", "ack_flush_s", "reclaim_batches", "delivery_attempts")


@dataclass(frozen=True)
class SubscribeOptions:
    """Later values replace earlier ones. Every number is positive but ``max_retries``, which may be zero."""

    batch_size: int = 100
    concurrency: int = 10
    handler_timeout_s: float = 30.0
    backoff_min_ms: int = 100
    backoff_max_ms: int = 10_000
    max_retries: int | None = None
    share_attempts: int | None = None
    start_offset: str | None = None
    queue_depth: int | None = None
    pending_idle_s: float | None = None
    redeliver_s: float | None = None
    ack_batch: int | None = None
    ack_flush_s: float | None = None
    reclaim_batches: int | None = None
    delivery_attempts: int | None = None

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name == "start_offset":
                if v not in (None, "earliest", "latest"):
                    raise InvalidArgument(f"start_offset is earliest or latest, not {v!r}")
            elif v is not None and (v < 0 if f.name == "max_retries" else v <= 0):
                raise InvalidArgument(f"{f.name} must be positive, not {v}")
        if self.backoff_min_ms > self.backoff_max_ms:
            raise InvalidArgument("the least backoff is above the most")

    def with_(self, **values) -> SubscribeOptions:
        return replace(self, **values)

    def for_log(self, share: bool = False) -> SubscribeOptions:
        """For a partitioned log, as an ordered group or a share group; options of another kind are errors."""
        self._only(_STREAM, "a log")
        if share and (self.max_retries is not None or self.start_offset is not None):
            raise InvalidArgument("max_retries and start_offset are for ordered groups")
        if not share and self.share_attempts is not None:
            raise InvalidArgument("share_attempts is for share groups")
        if (self.share_attempts or 0) > MOST_SHARE_ATTEMPTS:
            raise InvalidArgument(f"share_attempts is at most {MOST_SHARE_ATTEMPTS}")
        return self.with_(max_retries=None if share else self.max_retries if self.max_retries is not None else 3, share_attempts=(self.share_attempts or MOST_SHARE_ATTEMPTS) if share else None)

    def for_stream(self) -> SubscribeOptions:
        """For a field stream; defaults are filled in."""
        self._only(_LOG, "a field stream")
        out = self.with_(queue_depth=self.queue_depth or 64, pending_idle_s=self.pending_idle_s or 60.0, redeliver_s=self.redeliver_s or 15.0, ack_batch=self.ack_batch or 64, ack_flush_s=self.ack_flush_s or 0.002, reclaim_batches=self.reclaim_batches or 4, delivery_attempts=self.delivery_attempts or 5)
        if out.pending_idle_s < out.handler_timeout_s:
            raise InvalidArgument("pending_idle_s is under handler_timeout_s")
        return out

    def _only(self, foreign: tuple[str, ...], backend: str) -> None:
        if used := [n for n in foreign if getattr(self, n) is not None]:
            raise InvalidArgument(f"{used[0]} is no option of {backend}")
