"""Jobs: one active at a time, and what a restart makes of it."""

from __future__ import annotations

import threading
from collections.abc import Callable

# States, and those in which a job is over.
ACTIVE = ("queued", "running", "cancelling")
OVER = ("succeeded", "failed", "cancelled", "interrupted")
MOVES = {"queued": ("running", "cancelled", "interrupted"), "running": ("succeeded", "failed", "cancelling", "interrupted"), "cancelling": ("cancelled", "failed", "succeeded", "interrupted")}


class Jobs:
    """State rows of jobs, by number; ``saved`` is called with every row that changes, and makes it durable."""

    def __init__(self, rows: list[dict] = (), saved: Callable[[dict], None] = lambda row: None):
        self.rows, self.saved, self.lock = {row["id"]: dict(row) for row in rows}, saved, threading.Lock()
        for row in self.rows.values():
            if row["state"] in ACTIVE:  # nothing survives a restart
                row["state"] = "interrupted"
                saved(dict(row))

    def active(self) -> dict | None:
        return next((dict(r) for r in self.rows.values() if r["state"] in ACTIVE), None)

    def start(self, kind: str, at: float) -> dict | None:
        """A new job, or nothing while another is active."""
        with self.lock:
            if self.active():
                return None
            row = {"id": max(self.rows, default=0) + 1, "kind": kind, "state": "queued", "since": at, "updated": at}
            self.rows[row["id"]] = row
            self.saved(dict(row))
            return dict(row)

    def move(self, key: int, to: str, at: float) -> dict:
        with self.lock:
            row = self.rows[key]
            if to not in MOVES.get(row["state"], ()):
                raise ValueError(f"{row['state']} does not become {to}")
            row |= {"state": to, "updated": at}
            self.saved(dict(row))
            return dict(row)
