"""Tokens that are used once and rotate, expiry, orphans and caps, as machines over events in time order.

``Tokens`` holds one client's tokens. Kinds of events: ``issue`` (item is the token), ``rotate`` (item is presented, other is
its successor; without one the token is only consumed) and ``check``. A presented token is spent whatever comes of it. One that
was spent before and would still be alive means that someone else holds it: all tokens of the client are revoked.

``Buckets`` holds the rate windows of one share of all keys, at most ``most`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Machine, batch, stream

# Days of a refresh token, hours of grace for a client without tokens.
TOKEN_DAYS, GRACE_HOURS = 30, 1
_SECOND = 1_000_000


class Tokens(Machine):
    """Entries: token -> (expires, whether it is alive, 0). Own numbers: when the client came, since when it has had no token."""

    def __init__(self, seconds: float = TOKEN_DAYS * 86400, grace: float = GRACE_HOURS * 3600, most: int = 1000):
        self.life, self.grace, self.most = int(seconds * _SECOND), int(grace * _SECOND), most
        super().__init__()

    def alive(self) -> list[str]:
        return [k for k, v in self.entries.items() if v[1]]

    def _left(self, at: int) -> None:
        """Notes the time from which on no token is alive."""
        came, _, _ = self.own
        self.own = (came, -1 if self.alive() else at, 0)

    def deadline(self) -> int | None:
        came, empty, _ = self.own
        times = [v[0] for v in self.entries.values()]
        if came >= 0 and empty >= 0:
            times.append(max(came + self.grace, empty))
        return min(times, default=None)

    def due(self) -> Iterator[tuple]:
        at, (came, empty, _) = self.deadline(), self.own
        over = sorted(k for k, v in self.entries.items() if v[0] == at)
        for token in over:
            if self.entries.pop(token)[1]:
                if not self.alive():
                    self._left(at)
                yield at, "expire", token, "expired", len(self.alive())
        if not over:
            self.reset()
            yield at, "sweep", None, "orphaned", 0

    def on(self, at: int, kind: str, item: str, other: str | None) -> Iterator[tuple]:
        if self.own[0] < 0:
            self.own = (at, at, 0)
        if item is None or kind not in ("issue", "rotate", "check"):
            yield at, kind, item, "refused", len(self.alive())
        elif kind == "issue":
            yield from self._issue(at, kind, item)
        else:
            expires, alive, _ = self.entries.get(item, (0, 0, 0))
            if kind == "check":
                yield at, kind, item, "valid" if alive else "invalid", len(self.alive())
            elif alive:
                self.entries[item] = (expires, 0, 0)
                if other is not None and other not in self.entries:
                    yield from self._issue(at, kind, other, item)
                else:
                    self._left(at)
                    yield at, kind, item, "consumed", len(self.alive())
            elif item in self.entries:
                gone = self.alive()
                for token in gone:
                    del self.entries[token]
                if gone:
                    self._left(at)
                yield at, kind, item, "reused", len(gone)
            else:
                yield at, kind, item, "invalid", len(self.alive())

    def _issue(self, at: int, kind: str, token: str, presented: str | None = None) -> Iterator[tuple]:
        if token in self.entries:
            yield at, kind, token, "refused", len(self.alive())
            return
        self.entries[token] = (at + self.life, 1, 0)
        self._left(at)
        yield at, kind, presented or token, "rotated" if presented else "issued", len(self.alive())
        for oldest in self.alive()[: -self.most]:
            del self.entries[oldest]
            yield at, "evict", oldest, "evicted", len(self.alive())


class Buckets(Machine):
    """Entries: key -> (start of its window, hits, 0). Beyond ``most`` keys windows that are over leave, then the keys that came first."""

    def __init__(self, seconds: float, limit: int, most: int):
        self.length, self.limit, self.most = int(seconds * _SECOND), limit, most
        super().__init__()

    def on(self, at: int, kind: str, item: str, other: str | None) -> Iterator[tuple]:
        if item is None:
            return
        start, hits, _ = self.entries.get(item, (at, 0, 0))
        if start + self.length <= at:
            start, hits = at, 0
        self.entries[item] = (start, hits + 1, 0)
        yield at, "hit", item, "allowed" if hits < self.limit else "refused", hits + 1
        if len(self.entries) > self.most:
            for key in [k for k, v in self.entries.items() if v[0] + self.length <= at]:
                del self.entries[key]
                yield at, "evict", key, "over", 0
            for key in list(self.entries)[: max(0, len(self.entries) - self.most)]:
                yield at, "evict", key, "oldest", self.entries.pop(key)[1]


def _run(rows: DataFrame, machine: Machine, group: Column, time: str, kind: Column, item: Column, other: Column | None, watermark: str, until: str | None) -> DataFrame:
    if rows.isStreaming:
        return stream(rows, machine, group, time, kind, item, other, watermark)
    return batch(rows, machine, group, time, kind, item, other, until)


def token_log(
    rows: DataFrame, client: str, time: str, kind: Column, token: Column, successor: Column, seconds: float = TOKEN_DAYS * 86400,
    grace: float = GRACE_HOURS * 3600, most: int = 1000, watermark: str = "1 hour", until: str | None = None,
) -> DataFrame:
    """What becomes of each client's tokens (``SAID``), from a table or a stream of events.

    Outcomes: issued, rotated, consumed, valid, invalid, reused (n tokens revoked), refused, evicted, expired, orphaned.
    """
    return _run(rows, Tokens(seconds, grace, most), F.col(client), time, kind, token, successor, watermark, until)


def capped_hits(
    rows: DataFrame, key: str, time: str, seconds: float, limit: int, most: int, shares: int = 64, watermark: str = "1 hour", until: str | None = None
) -> DataFrame:
    """Hits and evictions (``SAID``) of a limiter that holds at most ``most`` keys: each of ``shares`` shares of the keys, by hash, holds its part of them.

    A share is at least one key; the parts add up to ``most`` at most, so fewer shares are used if there are more shares than keys.
    """
    shares = max(1, min(shares, most))
    share = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shares))
    return _run(rows.where(F.col(key).isNotNull()), Buckets(seconds, limit, most // shares), share, time, F.lit("hit"), F.col(key), None, watermark, until)
