"""A synthetic walk along three blocks: two outings and a query, heard through a simple radio model with a fixed seed."""

from __future__ import annotations

import json
import math
import random
from datetime import datetime, timedelta, timezone

TZ = timezone(timedelta(hours=-3))
METRE = math.radians(6_371_000.0)

# Crossings, the drawn blocks between them, and the routers (metres along the route, metres to its left).
NAMES = ["Rivera y Avenida Doctor Francisco Soca", "Rivera y Brito del Pino", "Rivera y Simón Bolívar", "Rivera y Obligado"]
MARKS = [(-34.903126, -56.156023), (-34.903131, -56.157581), (-34.903101, -56.159047), (-34.903011, -56.160359)]
BLOCKS = [
    [(-34.903126, -56.156023), (-34.903125495932514, -56.156022989469314), (-34.9031249, -56.1560654), (-34.9031258, -56.1562864), (-34.90313099919681, -56.1575810000048), (-34.903131, -56.157581)],
    [(-34.903131, -56.157581), (-34.90313099919681, -56.1575810000048), (-34.903131, -56.1575812), (-34.9031005, -56.1590468), (-34.90310049066178, -56.15904695411513), (-34.903101, -56.159047)],
    [(-34.903101, -56.159047), (-34.90310049066178, -56.15904695411513), (-34.9030598, -56.1597185), (-34.90301061870115, -56.16035895646694), (-34.903011, -56.160359)],
]
BESIDE = [
    (20, 12), (55, -18), (90, 9), (125, -22), (150, -10), (185, 20), (215, 8), (250, -15), (285, 14), (320, -9), (350, 24), (380, -11), (138.2, 30), (272, -30), (70, 80), (200, -90), (330, 70),
    (10, -65), (392, 95), (240, 60),
]
BANDS = [2412, 2437, 2462, 5180, 5200, 5220, 5240, 5745, 5765]


def metres(a, b):
    mid = math.cos(math.radians((a[0] + b[0]) / 2))
    return METRE * math.hypot((b[1] - a[1]) * mid, b[0] - a[0])


class World:
    def __init__(self):
        self.rng = random.Random(20260914)
        flat = math.cos(math.radians(BLOCKS[0][0][0]))
        line = BLOCKS[0] + BLOCKS[1][1:] + BLOCKS[2][1:]
        self.xy = [((o - line[0][1]) * flat * METRE, (a - line[0][0]) * METRE) for a, o in line]
        self.upto = [0.0]
        for p, q in zip(self.xy, self.xy[1:], strict=False):
            self.upto.append(self.upto[-1] + math.dist(p, q))
        self.corners = [0.0]
        for block in BLOCKS:
            self.corners.append(self.corners[-1] + sum(metres(p, q) for p, q in zip(block, block[1:], strict=False)))
        self.routers = []
        for along, left in BESIDE:
            (x0, y0), (x1, y1), (x, y) = self.at(max(0.0, along - 1)), self.at(min(self.upto[-1], along + 1)), self.at(along)
            way = math.dist((x0, y0), (x1, y1))
            self.routers.append((x - (y1 - y0) / way * left, y + (x1 - x0) / way * left, self.rng.uniform(-45.0, -35.0)))

    def at(self, along):
        along = min(self.upto[-1], max(0.0, along))
        k = next(k for k in range(1, len(self.upto)) if along <= self.upto[k])
        legs = self.upto[k] - self.upto[k - 1]
        share = (along - self.upto[k - 1]) / legs if legs > 0 else 0.0
        (x0, y0), (x1, y1) = self.xy[k - 1], self.xy[k]
        return x0 + (x1 - x0) * share, y0 + (y1 - y0) * share

    def heard(self, along, drift):
        x, y = self.at(along)
        found = []
        for n, ((rx, ry, power), own) in enumerate(zip(self.routers, drift, strict=True), 1):
            far = math.sqrt((x - rx) ** 2 + (y - ry) ** 2 + 9)
            dbm = power + own - 25 * math.log10(max(far, 1.0)) + self.rng.gauss(0.0, 1.0)
            if dbm >= -90:
                found.append({"ssid": f"sample-ap-{n:02d}", "bssid": f"02:00:00:00:00:{n:02x}", "security": "open" if n in (6, 9) else "psk",
                              "frequency": BANDS[n % 9], "signal_dbm": round(dbm), "signal_percent": None, "connected": False})
        return found

    def drift(self):
        return [self.rng.gauss(0.0, 1.0) for _ in self.routers]

    def outing(self, token, start, marks, speed, stop=None):
        """(log lines, notebook text) of a walk through the marks; ``stop``: (metres walked, seconds)."""
        drift = self.drift()
        legs = [(self.corners[a], self.corners[b]) for a, b in zip(marks, marks[1:], strict=False)]
        walked = [0.0]
        for a, b in legs:
            walked.append(walked[-1] + abs(b - a))
        times = [w / speed + (stop[1] if stop and w > stop[0] else 0.0) for w in walked]
        lines, second = [], 0
        while second <= times[-1]:
            t = max(0.0, second - 3.0)
            if stop and t >= stop[0] / speed:
                t = max(stop[0] / speed, t - stop[1])
            w = min(walked[-1], max(0.0, t * speed))
            k = next((k for k in range(len(legs)) if w - walked[k] <= abs(legs[k][1] - legs[k][0])), len(legs) - 1)
            a, b = legs[k]
            along = a + (b - a) * ((w - walked[k]) / abs(b - a))
            when = (start + timedelta(seconds=second)).isoformat()
            lines.append(json.dumps({"time": when, "event": "scan", "outing": token, "interface": "sample0", "cycle": len(lines) + 1, "networks": self.heard(along, drift)}))
            second += 5
        notes = [f"{start + timedelta(seconds=round(t)):%H:%M:%S} {NAMES[m]} @ {MARKS[m][0]:.6f}, {MARKS[m][1]:.6f}" for t, m in zip(times, marks, strict=True)]
        return lines, "\n".join(notes) + "\n"


def write(folder):
    """Two outings, their notebooks, the streets and a query, as files."""
    world = World()
    c = world.corners
    for name, args in (
        ("r14", (datetime(2026, 9, 14, 17, tzinfo=TZ), [0, 1, 2, 3], 1.3, (c[1] + 0.4 * (c[2] - c[1]), 30.0))),
        ("r17", (datetime(2026, 9, 17, 17, tzinfo=TZ), [3, 2, 1, 0, 1], 1.4)),
    ):
        lines, notes = world.outing(f"sample-{name}", *args)
        (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
        (folder / f"{name}.txt").write_text(notes)
    drift = world.drift()
    heard = world.heard(c[1] + 0.6 * (c[2] - c[1]), drift)
    (folder / "query.jsonl").write_text(json.dumps({"time": "2026-09-21T17:03:00-03:00", "event": "scan", "outing": "q", "cycle": 1, "networks": heard}) + "\n")
    (folder / "streets.jsonl").write_text("\n".join(json.dumps({"street": "Rivera", "line": b[1:-1]}) for b in BLOCKS) + "\n")
