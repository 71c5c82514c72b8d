"""Calls of an outside service from tasks: retried by a rule, at a bounded rate, a few at a time."""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

Retry = tuple[type[BaseException], ...] | Callable[[BaseException], bool]


class CallFailed(Exception):
    """A call that was given up: the error, and how many attempts it took."""

    def __init__(self, error: BaseException, attempts: int):
        super().__init__(str(error))
        self.error, self.attempts = error, attempts


def retried_by_name(names: Iterable[str]) -> Callable[[BaseException], bool]:
    """Errors of these very classes, by name, and timeouts and broken connections of any kind."""
    known = frozenset(names)
    return lambda e: type(e).__name__ in known or isinstance(e, (TimeoutError, ConnectionError))


def with_retries(call: Callable[[], dict], retry: Retry, attempts: int = 5, sleep: Callable[[float], None] = time.sleep, pace: Callable[[], None] = lambda: None) -> tuple[dict, int]:
    """The call's answer and the attempts it took; CallFailed carries the last error and its attempts. Waits between attempts are 1, 2, 4 ... 30 seconds and up to half a second more; pace is called before each."""
    again = retry if not isinstance(retry, tuple) else lambda e: isinstance(e, retry)
    for n in range(1, attempts + 1):
        pace()
        try:
            return call(), n
        except Exception as e:
            if n == attempts or not again(e):
                raise CallFailed(e, n) from e
            sleep(min(30, 2 ** (n - 1)) + random.uniform(0, 0.5))
    raise ValueError("at least one attempt is needed")


class Pace:
    """At most so many calls a second, spread evenly; None sets no bound."""

    def __init__(self, a_second: float | None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.gap, self.sleep, self.clock = 1 / a_second if a_second else 0.0, sleep, clock
        self.lock, self.free = threading.Lock(), 0.0

    def __call__(self) -> None:
        if not self.gap:
            return
        with self.lock:
            now = self.clock()
            at = max(now, self.free)
            self.free = at + self.gap
        if at > now:
            self.sleep(at - now)


def in_order(work: Callable, rows: Iterable, at_once: int) -> Iterator:
    """work(row) of each row, in order; at_once of them run at a time, and twice as many wait or are done but not taken."""
    if at_once <= 1:
        yield from map(work, rows)
        return
    with ThreadPoolExecutor(at_once) as pool:
        waiting: deque = deque()
        for row in rows:
            waiting.append(pool.submit(work, row))
            if len(waiting) >= 2 * at_once:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()
