"""Requests with retries and a shared budget, for the sources that read from a server."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable

Fetch = Callable[[int, int], bytes]


class Budget:
    """At most ``rate`` requests a second; none or 0 is no limit. Tasks that share a budget get a part of the rate each."""

    def __init__(self, rate: float | None = None):
        self.gap = 1 / rate if rate else 0.0
        self.next = 0.0

    def spend(self) -> None:
        if self.gap:
            now = time.monotonic()
            if now < self.next:
                time.sleep(self.next - now)
            self.next = max(now, self.next) + self.gap


def request(url: str, method: str = "GET", span: str | None = None, token: str | None = None, attempts: int = 3, timeout: int = 60, budget: Budget | None = None) -> tuple[dict, bytes]:
    """Headers (lower-case names) and body. Failures of the server and refusals for haste are tried again, with respect for Retry-After."""
    headers = {"Authorization": f"Bearer {token}"} if token else {}
    if span:
        headers["Range"] = span
    for k in range(attempts):
        if budget:
            budget.spend()
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers, method=method), timeout=timeout) as r:
                return {n.lower(): v for n, v in r.headers.items()}, r.read()
        except urllib.error.HTTPError as e:
            if k + 1 == attempts or e.code < 500 and e.code != 429:
                raise
            time.sleep(_wait(e.headers.get("Retry-After"), k))
        except OSError:
            if k + 1 == attempts:
                raise
            time.sleep(2**k)
    raise ValueError("no attempt was allowed")


def _wait(asked: str | None, k: int) -> float:
    try:
        return min(30.0, max(0.0, float(asked)))
    except (TypeError, ValueError):
        return float(2**k)


def ranges(url: str, token: str | None = None, attempts: int = 3, timeout: int = 60, budget: Budget | None = None) -> tuple[int, Fetch]:
    """Length of a remote file and a function that reads a range of it."""
    head, _ = request(url, "HEAD", None, token, attempts, timeout, budget)
    return int(head["content-length"]), reader(url, token, attempts, timeout, budget)


def reader(url: str, token: str | None = None, attempts: int = 3, timeout: int = 60, budget: Budget | None = None) -> Fetch:
    return lambda start, n: request(url, "GET", f"bytes={start}-{start + n - 1}", token, attempts, timeout, budget)[1]
