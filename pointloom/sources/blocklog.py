"""A folder of served blocks, so that a block that is read again has the values it had first.

The folder is a path that driver and executors share. A block is a file that is written
beside its place and then linked into it: of several tasks that ask for one block the first
one wins, and all serve what its file holds.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable


class BlockLog:
    def __init__(self, folder: str) -> None:
        self.folder = folder.removeprefix("file://").removeprefix("file:")
        if "://" in self.folder or not self.folder.startswith("/"):
            raise ValueError("the log has to be the absolute path of a folder that driver and executors share")

    def _path(self, block: int) -> str:
        return f"{self.folder}/block-{block:015d}.json"

    def values(self, block: int, ask: Callable[[], list]) -> list:
        """The values of a block: those in the log, or else ``ask``'s, logged first."""
        path = self._path(block)
        if not os.path.exists(path):
            os.makedirs(self.folder, exist_ok=True)
            beside = f"{self.folder}/asked-{uuid.uuid4().hex}"
            try:
                with open(beside, "w") as out:
                    json.dump(ask(), out)
                    out.flush()
                    os.fsync(out.fileno())
                os.link(beside, path)
            except FileExistsError:
                pass
            finally:
                if os.path.exists(beside):
                    os.remove(beside)
        with open(path) as found:
            return json.load(found)

    def _blocks(self) -> list[int]:
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return [int(n[6:-5]) for n in names if n.startswith("block-")]

    def count(self) -> int:
        """One more than the last block in the log."""
        return max(self._blocks(), default=-1) + 1

    def forget(self, end: int) -> None:
        """Drop blocks before ``end`` but the last one in the log, which tells how far it is."""
        keep = self.count() - 1
        for block in self._blocks():
            if block < end and block != keep:
                os.remove(self._path(block))
