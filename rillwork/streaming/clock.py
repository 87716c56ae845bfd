"""Clocks of live manifests, and rooms recorded on a schedule: small loops on the driver."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

from ..operators.fetch import file_opener

#: Schemes of time sources by the end of their identifiers.
SCHEMES = ("http-xsdate", "http-iso", "http-head", "direct")


def utc_timings(manifest: str) -> list[tuple[str, str]]:
    """(scheme, value) of the UTCTiming elements of a manifest, in order."""
    out = []
    for tag in re.findall(r"<UTCTiming\b[^>]*>", manifest):
        member = lambda name: (re.search(rf'\b{name}\s*=\s*"([^"]*)"', tag) or [None, ""])[1]  # noqa: B023, E731
        out.append((member("schemeIdUri"), member("value")))
    return out


def _moment(text: str) -> datetime:
    t = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def clock_offset_us(timings: list[tuple[str, str]], opener: Callable = file_opener, head: Callable[[str], str] | None = None, now_us: Callable[[], int] = lambda: time.time_ns() // 1000) -> int:
    """Microseconds to add to the local clock: of the first source that answers; 0 where none is listed.

    Half the time a request took is added to what it said. Network time protocols are refused; a list of which no source answers is an error.
    """
    problems = []
    for scheme, value in timings:
        kind = next((k for k in SCHEMES if re.search(rf":{k}(?::\d{{4}})?$", scheme)), None)
        if kind is None:
            problems.append(f"{scheme} is not supported")
            continue
        for address in value.split() if kind != "direct" else [value]:
            began = now_us()
            try:
                if kind == "direct":
                    said = _moment(address)
                elif kind == "http-head":
                    said = parsedate_to_datetime((head or _head)(address))
                else:
                    said = _moment(opener(address, None, {}).decode())
            except (OSError, ValueError, TypeError) as e:
                problems.append(f"{address}: {e}")
                continue
            ended = now_us()
            return int(said.timestamp() * 1_000_000) + (ended - began) // 2 - ended
    if timings:
        raise OSError("; ".join(problems))
    return 0


def _head(url: str) -> str:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, method="HEAD"), timeout=10) as r:
        return r.headers["Date"]


class Schedule:
    """Rooms looked at in slots of `slot` seconds; at most one run per room at a time.

    start(room) begins a recording and gives a function that tells whether it still runs, or None where the room is not live. After an error a room rests for `rest` seconds.
    """

    def __init__(self, start: Callable[[str], Callable[[], bool] | None], slot: float = 30.0, rest: float = 20.0):
        self.start, self.slot, self.rest = start, slot, rest
        self.rooms: list[str] = []
        self.running: dict[str, Callable[[], bool]] = {}
        self.resting: dict[str, float] = {}
        self.next = 0.0

    def reload(self, rooms: list[str]) -> None:
        """The wanted rooms, each once; runs of rooms that are gone go on to their end."""
        self.rooms = list(dict.fromkeys(rooms))

    def tick(self, now: float) -> list[str]:
        """Starts what is due at `now`; the rooms started."""
        self.running = {r: alive for r, alive in self.running.items() if alive()}
        if now < self.next:
            return []
        self.next = (now // self.slot + 1) * self.slot
        begun = []
        for room in self.rooms:
            if room in self.running or self.resting.get(room, 0.0) > now:
                continue
            try:
                alive = self.start(room)
            except Exception:  # noqa: BLE001  whatever a room's start raises, the others go on
                self.resting[room] = now + self.rest
                continue
            if alive is not None:
                self.running[room] = alive
                begun.append(room)
        return begun

    def run(self, stop: Callable[[], bool], sleep: float = 1.0) -> None:
        while not stop():
            self.tick(time.time())
            time.sleep(sleep)
