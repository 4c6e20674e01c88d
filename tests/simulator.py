"""The window rules, record by record, in plain Python; independent of Spark and of the SQL."""

from __future__ import annotations

from collections import defaultdict


def tumbling(ms: int, size: int) -> list[int]:
    return [ms // size * size]


def sliding(ms: int, size: int, slide: int) -> list[int]:
    newest = ms // slide * slide
    return [s for s in range(newest, newest - size, -slide) if s <= ms < s + size]


def simulate(rows, assign, size, bound, lateness):
    """rows: (key, value, event_ms) in order of arrival -> emissions, late rows, watermarks as they advance.

    An emission: (key, start, end, value, seq of the record whose watermark released it; None at the end).
    """
    sums, dirty, state = defaultdict(int), set(), set()
    emissions, late, marks = [], [], []
    top = None
    wm = None

    def fire(at, seq):
        for cell in sorted(state):
            if cell[1] + size <= at and cell in dirty:
                emissions.append((cell[0], cell[1], cell[1] + size, sums[cell], seq))
                dirty.discard(cell)
        for cell in [c for c in state if c[1] + size + lateness <= at]:
            state.discard(cell)
            del sums[cell]

    for seq, (key, value, ms) in enumerate(rows):
        taken = False
        for start in assign(ms):
            if wm is not None and start + size + lateness <= wm:
                continue
            cell = (key, start)
            sums[cell] += value
            state.add(cell)
            dirty.add(cell)
            taken = True
        if not taken:
            late.append(seq)
        top = ms if top is None else max(top, ms)
        if wm is None or top - bound > wm:
            wm = top - bound
            marks.append((seq, wm))
            fire(wm, seq)
    fire(float("inf"), None)
    return emissions, late, marks


def sessions(rows, gap):
    """rows: (key, value, event_ms), none late -> (key, start, end, sum)."""
    by_key = defaultdict(list)
    for key, value, ms in rows:
        by_key[key].append((ms, value))
    out = []
    for key, own in by_key.items():
        own.sort()
        start, end, total = own[0][0], own[0][0] + gap, 0
        for ms, value in own:
            if ms >= end:
                out.append((key, start, end, total))
                start, total = ms, 0
            end, total = max(end, ms + gap), total + value
        out.append((key, start, end, total))
    return out
