"""The commit log: a JSON file for each version, published atomically, folded into the table of files.

Every ``CHECKPOINT`` versions the folded state is written beside the edits, so a
reader that opens the log reads one checkpoint and the edits after it. A reader that
has a version asks for the ones after it by name, without listing the folder.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

from sediment.model import CommitConflict
from sediment.sources.files import Files

FOLDER = "_log"
#: Attempts to commit beside other writers, and versions from one checkpoint to the next.
ATTEMPTS, CHECKPOINT = 200, 50


@dataclass(frozen=True)
class FileEntry:
    """A data file. Bounds are hexadecimal bytes, so that any key survives JSON and orders as its bytes do."""

    path: str
    level: int
    min_key: str
    max_key: str
    file_size: int
    seq_num: int
    rows: int = 0


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    files: dict[str, FileEntry] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def next_seq(self) -> int:
        return self.version + 1

    def level(self, n: int) -> list[FileEntry]:
        """Level 0 newest first, others by their smallest key."""
        own = [f for f in self.files.values() if f.level == n]
        return sorted(own, key=lambda f: (-f.seq_num, f.path) if n == 0 else (f.min_key, f.path))


def after(now: Snapshot, edits: Iterable[dict]) -> Snapshot:
    """The state after some edits. In each, removals come first; an unknown one does nothing."""
    files, batches, version = dict(now.files), dict(now.batches), now.version
    for edit in edits:
        for path in edit["removed"]:
            files.pop(path, None)
        files.update((f["path"], FileEntry(**f)) for f in edit["added"])
        if edit.get("batch"):
            batches[edit["batch"][0]] = edit["batch"][1]
        version = edit["version"]
    return Snapshot(version, files, batches)


class CommitLog:
    def __init__(self, files: Files):
        self.files = files
        files.make(FOLDER)
        self._known: Snapshot | None = None

    @staticmethod
    def name(version: int, kind: str = "json") -> str:
        return f"{FOLDER}/{version:020d}.{kind}"

    def _numbers(self, kind: str) -> list[int]:
        return [int(n[:20]) for n, _ in self.files.list(FOLDER) if n[:20].isdigit() and n[20:] == f".{kind}"]

    def versions(self) -> list[int]:
        return self._numbers("json")

    def edit(self, version: int) -> dict:
        return json.loads(self.files.read(self.name(version)))

    def history(self) -> Iterator[dict]:
        """All edits, newest first, read one by one as they are asked for."""
        return (self.edit(v) for v in reversed(self.versions()))

    def _opened(self, version: int | None) -> Snapshot:
        """The newest checkpoint that isn't beyond ``version``."""
        found = [v for v in self._numbers("checkpoint") if version is None or v <= version]
        if not found:
            return Snapshot()
        state = json.loads(self.files.read(self.name(found[-1], "checkpoint")))
        return Snapshot(state["version"], {f["path"]: FileEntry(**f) for f in state["files"]}, state["batches"])

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The state at a version; without one the latest, for which only new commits are read."""
        if version == 0:
            return Snapshot()
        if version is not None:
            now = self._opened(version)
            if version not in self.versions():
                raise ValueError(f"no version {version}")
            return after(now, (self.edit(v) for v in range(now.version + 1, version + 1)))
        now, new = self._known or self._opened(None), []
        while self.files.exists(self.name(now.version + len(new) + 1)):
            new.append(self.edit(now.version + len(new) + 1))
        self._known = after(now, new) if new else now
        return self._known

    def commit(self, make: Callable[[Snapshot], dict | None]) -> Snapshot:
        """Add what ``make`` gives for the latest state (None: nothing to do); it is asked again if another writer was first."""
        for _ in range(ATTEMPTS):
            now = self.snapshot()
            edit = make(now)
            if edit is None:
                return now
            edit = {"version": now.version + 1, "time": int(time.time() * 1000), "added": [], "removed": [], "batch": None} | edit
            edit["added"] = [asdict(f) if isinstance(f, FileEntry) else f for f in edit["added"]]
            if missing := [p for p in edit["removed"] if p not in now.files]:
                raise CommitConflict(f"gone already: {missing[:3]}")
            try:
                self.files.publish(self.name(edit["version"]), json.dumps(edit))
            except CommitConflict:
                continue
            made = self._known = after(now, [edit])
            if made.version % CHECKPOINT == 0:
                self._checkpoint(made)
            return made
        raise CommitConflict("too many other writers")

    def _checkpoint(self, now: Snapshot) -> None:
        state = {"version": now.version, "batches": now.batches, "files": [asdict(f) for f in now.files.values()]}
        self.files.publish(self.name(now.version, "checkpoint"), json.dumps(state))
