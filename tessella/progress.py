"""Progress of long runs on Python's logging: timers, steps, speeds, a summary."""

from __future__ import annotations

import logging
import time

log = logging.getLogger("tessella")


def clock(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600} hr {s % 3600 // 60} min" if s >= 3600 else f"{s // 60} min {s % 60} sec"


class Progress:
    """Use as a context manager; the whole run is timed as ``total``."""

    def __init__(self, total: int | None = None, every_share: float = 0.1, every_seconds: float = 600.0):
        self.total, self.every_share, self.every_seconds = total, every_share, every_seconds
        self.began: dict[str, float] = {}
        self.took: dict[str, float] = {}
        self.last = (0, time.monotonic())

    def __enter__(self) -> "Progress":
        self.start("total")
        return self

    def __exit__(self, *_) -> None:
        self.stop("total")
        self.summary()

    def start(self, name: str) -> None:
        self.began[name] = time.monotonic()

    def stop(self, name: str) -> float:
        self.took[name] = self.took.get(name, 0.0) + time.monotonic() - self.began.pop(name)
        return self.took[name]

    def report(self, done: int, **metrics) -> bool:
        """Log when a share of the work or of the time has passed since the last line."""
        at, when = self.last
        now = time.monotonic()
        far = bool(self.total) and done - at >= self.every_share * self.total
        if not (far or now - when >= self.every_seconds or done == self.total):
            return False
        speed = (done - at) / max(now - when, 1e-9)
        whole = done / max(now - self.began.get("total", when), 1e-9)
        left = f", {clock((self.total - done) / max(whole, 1e-9))} left" if self.total else ""
        log.info("%s done, %.1f a second now, %.1f on average%s%s", f"{done:,}", speed, whole, left, "".join(f", {k} {v}" for k, v in metrics.items()))
        self.last = (done, now)
        return True

    def summary(self) -> dict[str, float]:
        """Percent of the total by timer."""
        whole = self.took.get("total", 0.0)
        shares = {n: 100 * s / whole if whole else 0.0 for n, s in self.took.items()}
        for n, s in self.took.items():
            log.info("%s: %s (%.1f %%)", n, clock(s), shares[n])
        return shares
