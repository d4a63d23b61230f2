"""Controllers simulated over ordered observations: spill modes, circuit breaker, batch tuner, worker scaler, backoff."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("memory_only", "partial_disk", "all_disk", "load_shedding")


def spill_mode(mode: int, used: float, spill: float = 0.8, calm: float = 0.7) -> int:
    """The next mode: up at once, down one step, all the way below calm; between calm and spill as it is."""
    target = 3 if used >= spill + 0.15 else 2 if used >= spill + 0.10 else 1 if used >= spill else 0 if used < calm else mode
    return target if target >= mode or target == 0 else mode - 1


@dataclass
class Circuit:
    """Opens after a run of failures, lets one probe through after a pause, closes when that succeeds."""

    most: int = 5
    pause_s: int = 30
    state: str = "closed"
    fails: int = 0
    last: int = 0
    probing: bool = False

    def allow(self, now_s: int) -> bool:
        if self.state == "open" and now_s - self.last >= self.pause_s:
            self.state, self.probing = "half_open", True
            return True
        if self.state == "half_open" and not self.probing:
            self.probing = True
            return True
        return self.state == "closed"

    def record(self, ok: bool, now_s: int) -> None:
        if ok:
            self.fails = 0
            if self.state == "half_open":
                self.state, self.probing = "closed", False
            return
        self.fails += 1
        self.last = now_s
        if self.state == "half_open":
            self.state, self.probing = "open", False
        elif self.state == "closed" and self.fails >= self.most:
            self.state = "open"


@dataclass
class BatchTuner:
    """Grows by a quarter after ten successes, halves on failure; too-large answers set a ceiling."""

    now: int = 4 << 20
    least: int = 512
    most: int = 16 << 20
    streak: int = 0
    ceiling: int = 0

    def success(self) -> None:
        self.streak += 1
        if self.streak >= 10:
            self.streak = 0
            self.now = min(int(self.now * 1.25), self.most, self.ceiling or self.most)

    def failure(self, too_large: bool) -> None:
        self.streak = 0
        if too_large:
            self.ceiling = max(int(self.now * 0.8), self.least)
        self.now = max(int(self.now * 0.5), self.least)


@dataclass
class Scaler:
    """One worker more while the queue is long and exports are quick; half as many after sustained idleness."""

    now: int = 1
    least: int = 1
    most: int = 16
    high: int = 100
    low: int = 10
    slow_ns: int = 500_000_000
    idle_s: int = 30
    alpha: float = 0.3
    latency_ns: int = 0
    idle_since: int = -1

    def observe(self, ns: int) -> None:
        self.latency_ns = ns if self.latency_ns == 0 else int(self.alpha * ns + (1 - self.alpha) * self.latency_ns)

    def decide(self, depth: int, now_s: int) -> None:
        if depth > self.high and self.now < self.most and self.latency_ns <= self.slow_ns:
            self.now += 1
            self.idle_since = -1
        elif depth >= self.low:
            self.idle_since = -1
        elif self.idle_since < 0:
            self.idle_since = now_s
        elif now_s - self.idle_since >= self.idle_s and self.now > self.least:
            self.now = max(self.now // 2, self.least)
            self.idle_since = -1


def folded(df: DataFrame, key: str, order: str, fold, out: str) -> DataFrame:
    """df's rows of each key in order, with the fold's answer to each; fold(rows as tuples) gives a list.

    A controller is sequential; its rows are observations of one queue or exporter, not datapoints.
    """
    cols = df.columns
    name, kind = out.split()

    def run(pdf):
        pdf = pdf.sort_values(order)
        pdf[name] = fold(list(pdf[cols].itertuples(index=False, name=None)))
        return pdf

    return df.groupBy(key).applyInPandas(run, ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", {name} {kind}")


# Folds over rows (queue, seq, value, ok): value stands for pressure or latency, seq for seconds.


def spill_modes(rows):
    mode, out = 0, []
    for _, _, v, _ in rows:
        mode = spill_mode(mode, min(v / 40, 1.0))
        out.append(MODES[mode])
    return out


def circuit_states(rows):
    c, out = Circuit(3, 60), []
    for _, seq, _, ok in rows:
        if c.allow(int(seq)):
            c.record(bool(ok), int(seq))
        out.append(c.state)
    return out


def tuned_bytes(rows):
    t, out = BatchTuner(), []
    for _, seq, _, ok in rows:
        t.success() if ok else t.failure(seq % 5 == 0)
        out.append(t.now)
    return out


def scaled_workers(rows):
    w, out = Scaler(), []
    for _, seq, v, _ in rows:
        w.observe(int(v * 1e6))
        w.decide(int(v * 4) % 200, int(seq))
        out.append(w.now)
    return out


def backoff(retries: Column, base_ms: int, most_ms: int) -> Column:
    """base * 2**retries up to the most; 0 before the first retry."""
    return F.when(retries <= 0, F.lit(0.0)).otherwise(F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), retries), F.lit(float(most_ms))))


def error_class(status: Column) -> Column:
    return (
        F.when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limit")
        .when((status >= 400) & (status < 500), "client_error")
        .when(status >= 500, "server_error")
        .otherwise("unknown")
    )


def retryable(kind: Column) -> Column:
    return kind.isin("server_error", "network", "timeout", "rate_limit")


# Parts of messages by which servers say that a payload is too large.
TOO_LARGE = ("too big", "too large", "exceeds", "exceeding", "maxrequestsize", "max_request_size")


def splittable(status: Column, message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    said = F.lit(False)
    for part in TOO_LARGE:
        said = said | low.contains(part)
    return (status == 413) | ((status >= 400) & (status < 500) & ~status.isin(401, 403, 429) & said)
