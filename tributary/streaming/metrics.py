"""How early results arrive: input rows read against output rows written."""

from __future__ import annotations

import math


def progress_curve(progress: list[dict]) -> list[tuple[int, int, int]]:
    """(rows read so far, rows written so far, rows of state) after each micro-batch."""
    curve, read, written = [], 0, 0
    for p in progress:
        read += p.get("numInputRows", 0) or 0
        written += max(0, (p.get("sink") or {}).get("numOutputRows", 0) or 0)
        curve.append((read, written, sum(op["numRowsTotal"] for op in p.get("stateOperators", []))))
    return curve


def phase_curve(progress: list[dict]) -> list[tuple[int, int]]:
    """(rows read so far, rows written so far) after each phase step of tributary.streaming.phased."""
    curve, written = [], 0
    for p in progress:
        written += p["rows_written"]
        curve.append((p["rows_read"], written))
    return curve


def expected_reads_random(x: float, rows: float = 1e6) -> float:
    """Rows that must be read for the x-th result when two shuffled sides of `rows` equal keys arrive at one rate."""
    return 2 * math.sqrt(x * rows)


def expected_reads_one_in_ten(x: float) -> float:
    """The same for a million rows against a hundred thousand, the smaller arriving twice as fast."""
    return math.sqrt(x * 9e6 / 2) if x <= 5000 else 10 * x + 1e5
