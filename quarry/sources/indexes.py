"""The catalogue of lexical indexes: one for each scope of a store, found by every process.

An index lies under the store's own folder, named by its scope, and notes the store's
version that it follows.  Whoever finds it behind brings it up to date: by the rows
that came and went since, or anew where the store was compacted or vacuumed meanwhile.
One caller builds at a time; the others wait for the lease to end or to lapse."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import filters, lexical
from quarry.operators.delta import DeltaIndex, View
from quarry.sources.store import Snapshot, Store

#: Seconds that a builder may take before another may take over, and between looks at its lease.
LEASE, PAUSE = 3600.0, 1.0
#: Versions of an index whose files stay for readers that began with them.
KEEP = 3


class Catalogue:
    def __init__(self, store: Store, lease: float = LEASE, pause: float = PAUSE):
        self.store, self.folder, self.lease, self.pause = store, f"{store.path}/indexes", lease, pause

    def path(self, store_id: str, project_id: str | None = None, repo_root: str | None = None) -> str:
        scope = json.dumps([store_id, project_id or None, repo_root or None])
        return f"{self.folder}/{hashlib.sha256(scope.encode()).hexdigest()[:32]}"

    def get(self, store_id: str, project_id: str | None = None, repo_root: str | None = None, at: Snapshot | None = None) -> tuple[DeltaIndex, View]:
        """The index of a scope as of a version of the store (the latest if None)."""
        at = at or self.store.snapshot()
        index = DeltaIndex(self.store.spark, self.path(store_id, project_id, repo_root))
        while True:
            found = self._at(index, at)
            if found is not None:
                return index, found
            owner = self._acquire(index)
            if owner is None:
                time.sleep(self.pause)
                continue
            try:
                found = self._at(index, at)
                if found is None:
                    self._follow(index, at, (store_id, project_id, repo_root))
            finally:
                self._release(index, owner)

    def _at(self, index: DeltaIndex, at: Snapshot) -> View | None:
        """The newest view that follows this version of the store."""
        for n in sorted(index.versions.numbers(), reverse=True):
            view = index.view(n)
            if view.note and view.note["version"] == at.version:
                return view
        return None

    # ---- building

    def _acquire(self, index: DeltaIndex) -> str | None:
        lock, owner = f"{index.path}/lease", uuid.uuid4().hex
        if index.files.publish(lock, json.dumps({"owner": owner, "until": time.time() + self.lease})):
            return owner
        try:
            held = json.loads(index.files.text(lock))
        except Exception:  # given up between the two looks
            return None
        if held["until"] < time.time():
            index.files.remove(lock)
        return None

    def _release(self, index: DeltaIndex, owner: str) -> None:
        lock = f"{index.path}/lease"
        try:
            mine = json.loads(index.files.text(lock))["owner"] == owner
        except Exception:  # lapsed and taken over
            mine = False
        if mine:
            index.files.remove(lock)

    def _texts(self, rows: DataFrame, scope: tuple) -> DataFrame:
        store_id, project_id, repo_root = scope
        return lexical.index_text(filters.scoped(rows, project_id, repo_root, store_id).withColumn("chunk_id", F.col("id")))

    def _follow(self, index: DeltaIndex, at: Snapshot, scope: tuple) -> None:
        note = {"version": at.version, "at": time.time()}
        latest = index.versions.latest()
        seen = index.view(latest).note if latest else None
        changes = None
        if seen and seen["version"] < at.version and seen["version"] in self.store.versions.numbers():
            changes = self.store.changes(self.store.snapshot(seen["version"]), at)
        if changes is None:
            index.rebuild(self._texts(self.store.rows(at), scope), note, "string")
        else:
            added, gone = (self._texts(rows, scope) for rows in changes)
            if added.isEmpty() and gone.isEmpty():
                index.annotate(note)
            else:
                index.apply(added, gone.select("chunk_id"), note)
        index.vacuum(KEEP)

    def expire(self, older_s: float) -> list[str]:
        """Removes the indexes that followed no version lately; their folders."""
        out = []
        for name, _ in self.store.files.listed(self.folder):
            index = DeltaIndex(self.store.spark, f"{self.folder}/{name}")
            latest = index.versions.latest()
            note = index.view(latest).note if latest else None
            if not note or note["at"] < time.time() - older_s:
                self.store.files.remove(index.path)
                out.append(name)
        return out
