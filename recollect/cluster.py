"""Who holds a write: follower cursors, quorum, and the election of a leader. Plain state of the driver."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field


class NoQuorum(TimeoutError):
    pass


def majority(members: int) -> int:
    return members // 2 + 1


def elect(cursors: dict[str, int]) -> str | None:
    """The member that has read farthest; of equal ones the larger id."""
    return max(cursors, key=lambda k: (cursors[k], k)) if cursors else None


@dataclass
class Cluster:
    """Follower cursors as their replication polls report them; the leader is a member that holds every write."""

    quorum: int = 1
    cursors: dict[str, int] = field(default_factory=dict)
    moved: threading.Condition = field(default_factory=threading.Condition)

    def observe(self, follower: str, cursor: int) -> None:
        """A cursor never goes back."""
        with self.moved:
            if cursor > self.cursors.get(follower, 0):
                self.cursors[follower] = cursor
                self.moved.notify_all()

    def committed(self, target: int) -> bool:
        return 1 + sum(c >= target for c in self.cursors.values()) >= max(1, self.quorum)

    def wait(self, target: int, seconds: float) -> None:
        """Until a quorum holds the write; a timeout raises, and the write isn't acknowledged."""
        with self.moved:
            if not self.moved.wait_for(lambda: self.committed(target), seconds):
                raise NoQuorum(f"no quorum of {self.quorum} at {target}")
