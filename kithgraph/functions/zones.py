"""Versioned zone transition tables: per zone, sorted instants and offsets, for vectorised conversion."""

from __future__ import annotations

import os
import zoneinfo
from datetime import datetime, timedelta, timezone

import numpy as np

_FIRST, _LAST = datetime(1950, 1, 1, tzinfo=timezone.utc), datetime(2101, 1, 1, tzinfo=timezone.utc)
#: Two changes of one zone are never nearer than this.
_STEP = timedelta(days=4)


def installed_version() -> str:
    """The IANA release of the zone database `zoneinfo` reads here."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            try:
                with open(os.path.join(folder, name)) as f:
                    return f.readline().replace("# version", "").strip()
            except OSError:
                continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


class ZoneTables:
    """Transition tables of one zone-database release.

    The object travels to the workers with the release the driver had; a worker with another release
    refuses to build a table, so that one job never mixes two histories of the same zone.
    """

    def __init__(self, version: str | None = None):
        self.version = version or installed_version()
        self._built: dict[str, tuple[np.ndarray, np.ndarray] | None] = {}

    def __getstate__(self):
        return {"version": self.version}

    def __setstate__(self, state):
        self.version, self._built = state["version"], {}

    def get(self, name: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(wall seconds from which the next offset holds, offsets in seconds), or None for no such zone."""
        if name not in self._built:
            if installed_version() != self.version:
                raise RuntimeError(f"zone database {installed_version()} here, {self.version} on the driver")
            self._built[name] = self._build(name)
        return self._built[name]

    @staticmethod
    def _build(name: str):
        try:
            zone = zoneinfo.ZoneInfo(name)
        except Exception:
            return None

        def offset(at: datetime) -> int:
            return round(at.astimezone(zone).utcoffset().total_seconds())

        walls, offsets, at, now = [], [offset(_FIRST)], _FIRST, offset(_FIRST)
        while at < _LAST:
            after = at + _STEP
            if (new := offset(after)) != now:
                low, high = int(at.timestamp()), int(after.timestamp())
                while high - low > 1:  # the second at which the offset changes
                    mid = (low + high) // 2
                    low, high = (mid, high) if offset(datetime.fromtimestamp(mid, timezone.utc)) == now else (low, mid)
                # a repeated wall time is its first occurrence, a skipped one moves on by the skip:
                # either way the old offset holds until the later of the two wall clocks
                walls.append(high + max(now, new))
                offsets.append(new)
                now = new
            at = after
        return np.array(walls, dtype=np.int64), np.array(offsets, dtype=np.int64)

    def wall_to_utc(self, wall_s: np.ndarray, zones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of wall-clock seconds in their zones, and whether the zone is known."""
        out, known = wall_s.astype(np.int64, copy=True), np.zeros(len(wall_s), dtype=bool)
        for name in {z for z in zones if isinstance(z, str)}:
            at = zones == name
            held = self.get(name)
            if held is None:
                continue
            walls, offsets = held
            out[at] = wall_s[at] - offsets[np.searchsorted(walls, wall_s[at], side="right")]
            known |= at
        return out, known
