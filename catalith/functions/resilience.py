"""Guards for calls that leave the cluster: retries with backoff, a circuit breaker, fallbacks and timing."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

LOG = logging.getLogger("catalith")


class CircuitOpen(RuntimeError):
    """The breaker lets no call through."""


class CircuitBreaker:
    """Opens after so many failures in a row; after ``rest`` seconds one call may try again and closes it if it succeeds."""

    def __init__(self, failures: int = 5, rest: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.limit, self.rest, self.clock = failures, rest, clock
        self.failed, self.opened = 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half-open" if self.clock() - self.opened >= self.rest else "open"

    def call(self, function: Callable, *args, **kwargs):
        if self.state == "open":
            raise CircuitOpen(f"{self.failed} failures in a row")
        try:
            out = function(*args, **kwargs)
        except Exception:
            self.failed += 1
            if self.failed >= self.limit or self.opened is not None:
                self.opened = self.clock()
            raise
        self.failed, self.opened = 0, None
        return out


def retrying(attempts: int = 3, first: float = 1.0, most: float = 10.0, on: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep):
    """A decorator that calls again after 1, 2, 4, … seconds; the last error is raised."""

    def wrap(function: Callable) -> Callable:
        @functools.wraps(function)
        def run(*args, **kwargs):
            for k in range(attempts):
                try:
                    return function(*args, **kwargs)
                except on:
                    if k == attempts - 1:
                        raise
                    sleep(min(most, first * 2**k))

        return run

    return wrap


def first_of(*functions: Callable):
    """A function that returns the first result that is no error and not None; the last error is raised if there is none."""

    def run(*args, **kwargs):
        error: Exception | None = None
        for f in functions:
            try:
                out = f(*args, **kwargs)
            except Exception as e:  # noqa: BLE001 - the next one may do
                error = e
                continue
            if out is not None:
                return out
        if error is not None:
            raise error
        return None

    return run


def timed(slow_ms: float = 150.0):
    """A decorator that warns about calls slower than ``slow_ms`` and keeps the last duration as ``last_ms``."""

    def wrap(function: Callable) -> Callable:
        @functools.wraps(function)
        def run(*args, **kwargs):
            began = time.perf_counter()
            try:
                return function(*args, **kwargs)
            finally:
                run.last_ms = (time.perf_counter() - began) * 1000
                if run.last_ms > slow_ms:
                    LOG.warning("%s took %.0f ms", function.__name__, run.last_ms)

        run.last_ms = None
        return run

    return wrap
