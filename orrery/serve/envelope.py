"""Response envelopes with provenance."""

from __future__ import annotations

import os
import time
from dataclasses import asdict, dataclass, field

#: Seconds after which an index counts as stale.
STALE_AFTER = 300


def uuid7(now_ms: int | None = None) -> str:
    """A time-ordered identifier of version 7."""
    ms = int(time.time() * 1000) if now_ms is None else now_ms
    value = bytearray(ms.to_bytes(6, "big") + os.urandom(10))
    value[6] = value[6] & 0x0F | 0x70
    value[8] = value[8] & 0x3F | 0x80
    h = value.hex()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def is_uuid7(text: str) -> bool:
    """Whether a text is an identifier of version 7."""
    import re

    return bool(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", text))


@dataclass
class Provenance:
    """Where an answer comes from: live, stale or not ready."""

    source: str
    epoch: int | None = None
    age_seconds: float | None = None

    def __post_init__(self) -> None:
        if self.source not in ("live", "stale", "not_ready"):
            raise ValueError(f"unknown source {self.source!r}")
        if self.source == "not_ready" and self.epoch is not None:
            raise ValueError("an index that is not ready has no epoch")
        if self.age_seconds is not None and self.age_seconds < 0:
            raise ValueError("negative age")


def provenance(marker: dict | None, table_epoch: int | None, age_seconds: float) -> Provenance:
    """Ready only if the marker names the epoch of the tables; stale after five minutes."""
    if marker is None or marker.get("epoch") != table_epoch:
        return Provenance("not_ready")
    return Provenance("stale" if age_seconds > STALE_AFTER else "live", table_epoch, age_seconds)


@dataclass
class Envelope:
    """One response: data or an error, with warnings, whether it was cut, and its provenance."""

    ok: bool
    data: list | None = None
    error: str | None = None
    truncated: bool = False
    warnings: list[str] = field(default_factory=list)
    provenance: Provenance | None = None
    request_id: str = field(default_factory=uuid7)

    def to_dict(self) -> dict:
        return asdict(self)


def ok(data: list, where: Provenance, truncated: bool = False, warnings: list[str] | None = None) -> Envelope:
    return Envelope(True, data, None, truncated, warnings or [], where)


def failed(error: str, where: Provenance | None = None) -> Envelope:
    return Envelope(False, None, error, False, [], where)
