"""Which state partitions are live: a manifest that changes by one rename.

A version is a small JSON file `<path>/manifest/v<number>.json`, written under another name and renamed.
Readers take the highest version, so that they see the partitions of before or of after a commit, never
half. Partitions that no version names any more are deleted after the commit that left them out; a crash
in between leaves folders that nobody reads, and the next commit deletes them.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from . import fs

KEPT_VERSIONS = 3           # readers of the versions just before still find theirs


class Manifest:
    """tick, batch_id, other scalars and `live`: the committed ticks of each kind."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self.version, self.state = 0, {"tick": 0, "batch_id": -1, "live": {}}
        self.reload()

    def _file(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:012d}.json"

    def versions(self) -> list[int]:
        names = fs.names(self.spark, f"{self.root}/manifest")
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def reload(self) -> None:
        found = self.versions()
        if found:
            self.version = found[-1]
            self.state = json.loads(fs.read_text(self.spark, self._file(self.version)))

    def live(self, kind: str) -> list[int]:
        return list(self.state["live"].get(kind, []))

    def commit(self, **changes) -> None:
        """The next version; raises if another writer took it."""
        state = {**self.state, **changes}
        if not fs.write_new(self.spark, self._file(self.version + 1), json.dumps(state)):
            raise RuntimeError(f"another writer committed version {self.version + 1} of {self.root}")
        self.version, self.state = self.version + 1, state

    def sweep(self, kinds_root: str) -> list[tuple[str, int]]:
        """Delete partitions that the manifest does not name, and old versions."""
        gone = []
        for name in fs.names(self.spark, kinds_root):
            if not name.startswith("kind="):
                continue
            kind, keep = name[5:], set(self.live(name[5:]))
            for part in fs.names(self.spark, f"{kinds_root}/{name}"):
                if part.startswith("tick=") and int(part[5:]) not in keep:
                    fs.delete(self.spark, f"{kinds_root}/{name}/{part}")
                    gone.append((kind, int(part[5:])))
        for v in self.versions()[:-KEPT_VERSIONS]:
            fs.delete(self.spark, self._file(v))
        return gone
