"""Voice activity: hysteresis, re-blocking, routing and triggers as pure steps. Batch folds and streaming processors share them."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

RATE, BLOCK = 16000, 512
HIGH, LOW = 0.7, 0.55
MIN_SILENCE, PAD = 8000, 1600
PRE_ROLL = 16000


@dataclass
class Detector:
    """on after a probability of HIGH; off once one below LOW has not been followed by HIGH for MIN_SILENCE samples."""

    on: bool = False
    silent_since: int | None = None
    at: int = 0

    def step(self, probability: float) -> tuple[str, int] | None:
        self.at += BLOCK
        if probability >= HIGH:
            self.silent_since = None
            if not self.on:
                self.on = True
                return "start", max(0, self.at - PAD - BLOCK)
        elif probability < LOW and self.on:
            if self.silent_since is None:
                self.silent_since = self.at
            if self.at - self.silent_since >= MIN_SILENCE:
                end, self.on, self.silent_since = self.silent_since + PAD - BLOCK, False, None
                return "end", end
        return None


def merged(events: Iterable[tuple[str, int] | None]) -> dict[str, int]:
    """The events of one call as one: a later end wins, and a start after an end takes the end away, as speech goes on."""
    out: dict[str, int] = {}
    for event in events:
        if event is None:
            continue
        kind, at = event
        if kind == "end":
            out["end"] = at
        elif "end" in out:
            del out["end"]
        else:
            out.setdefault("start", at)
    return out


def blocks(held: list[float], arrived: list[float], size: int = BLOCK) -> tuple[list[list[float]], list[float]]:
    """(whole blocks, remainder) of what was held and what has arrived."""
    samples = held + arrived
    whole = len(samples) // size * size
    return [samples[k : k + size] for k in range(0, whole, size)], samples[whole:]


@dataclass
class Router:
    """Sends buffered audio on while there is voice; keeps PRE_ROLL samples of what comes before. Positions are samples."""

    status: str = "none"
    offset: int = 0  # of the buffer's first sample
    size: int = 0  # of the buffer
    pending: int = 0
    final: bool = False

    def _keep(self, most: int) -> None:
        drop = max(0, self.size - most)
        self.offset, self.size = self.offset + drop, self.size - drop

    def step(self, n_samples: int, event: dict[str, int]) -> list[tuple[str, int, int]]:
        """-> ('init', at, at) and ('send', from, to) in absolute samples."""
        self.size += n_samples
        out: list[tuple[str, int, int]] = []
        inside = lambda x: self.offset + min(max(0, x - self.offset), self.size)
        top = self.offset + self.size

        def send(a: int, b: int) -> None:
            if b > a:
                out.append(("send", a, b))
                self.pending += b - a

        if "start" in event and "end" in event:
            a, b = inside(event["start"]), inside(event["end"])
            if a < b:
                out.append(("init", a, a))
                send(a, b)
            self.status, self.final = "nonvoice", True
            self._keep(min(top - b, PRE_ROLL))
        elif "start" in event:
            a = inside(event["start"])
            out.append(("init", a, a))
            self.status = "voice"
            send(a, top)
            self._keep(0)
        elif "end" in event:
            b = inside(event["end"])
            send(self.offset, b)
            self.status, self.final = "nonvoice", True
            self._keep(min(top - b, PRE_ROLL))
        elif self.status == "voice":
            send(self.offset, top)
            self._keep(0)
        else:
            self._keep(PRE_ROLL)
        return out

    def trigger(self, chunk_seconds: float) -> str:
        """'finish' at the end of voice, 'run' once enough is pending, else 'wait'."""
        if self.final:
            self.status, self.offset, self.size, self.pending, self.final = "none", 0, 0, 0, False
            return "finish"
        if self.pending > RATE * chunk_seconds:
            self.pending = 0
            return "run"
        return "wait"


@dataclass
class Buffer:
    """Segments up to most seconds: the oldest leave while there is more than one and too much. Lengths that make most but for rounding are not too much."""

    most: float = 30.0
    lengths: list[float] = field(default_factory=list)

    def add(self, length: float) -> float:
        """Seconds that left."""
        self.lengths.append(length)
        gone = 0.0
        while len(self.lengths) > 1 and sum(self.lengths) > self.most + 1e-9:
            gone += self.lengths.pop(0)
        return gone


def whole_characters(held: bytes, arrived: bytes) -> tuple[str, bytes]:
    """(text, bytes of a character that isn't complete yet)."""
    raw = held + arrived
    for cut in range(len(raw), max(-1, len(raw) - 4), -1):
        try:
            return raw[:cut].decode(), raw[cut:]
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), b""


def state_of(x) -> dict:
    return asdict(x)
