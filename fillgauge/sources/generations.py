"""Folders whose content changes in one commit.

Files are never changed in place.  Every change writes a new folder beside what is there
and then commits a manifest: a small file with the next number, which lists all that belongs to the
new generation.  The manifest is written under another name and renamed into place, and the rename
fails if the number is taken; so of two writers one wins, and the other builds its change
again on the winner's generation.  A reader looks at the largest manifest once and reads what it
lists: all of one generation, whatever jobs are killed or still run meanwhile.

``FileContext.rename`` without overwriting is atomic on HDFS.  On a local disk it is a look and
a rename, and on object stores rename is a copy; there two writers need a lock of their own,
while readers still never see half a change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_MANIFESTS = "_generations"
#: Tries before a writer that always loses gives up.
TRIES = 100


class Hadoop:
    """Paths below ``root`` on whatever file system it lies."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = self.path(root)
        self.fs = self.root.getFileSystem(self._conf)

    def path(self, *parts: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))

    def below(self, *parts: str) -> Any:
        return self.path(self.root.toString(), *parts)

    def names(self, *parts: str) -> list[str]:
        """Names in a folder; none if it does not exist."""
        at = self.below(*parts) if parts else self.root
        if not self.fs.exists(at):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at))

    def text(self, *parts: str) -> str:
        stream = self.fs.open(self.below(*parts))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def put_if_absent(self, text: str, *parts: str) -> bool:
        """A new file with this content; False if there is one of that name."""
        target = self.below(*parts)
        beside = self.path(target.getParent().toString(), f".{uuid.uuid4().hex}")
        stream = self.fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        jvm = self._jvm
        options = jvm.java.lang.reflect.Array.newInstance(
            jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self._conf)
        try:
            context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(target), options)
        except Py4JJavaError as exc:
            self.fs.delete(beside, False)
            if "FileAlreadyExistsException" in exc.java_exception.getClass().getName():
                return False
            raise
        return True

    def drop(self, *parts: str) -> None:
        self.fs.delete(self.below(*parts), True)


def generations(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the generations whose manifests are still there, ascending."""
    found = [n.removesuffix(".json") for n in Hadoop(spark, root).names(_MANIFESTS)]
    return sorted(int(n) for n in found if n.isdigit())


def current(spark: SparkSession, root: str, generation: int | None = None) -> dict[str, Any] | None:
    """The manifest of the newest generation, or of the given one; None if nothing was committed."""
    known = generations(spark, root)
    if not known or (generation is not None and generation not in known):
        return None
    number = known[-1] if generation is None else generation
    return json.loads(Hadoop(spark, root).text(_MANIFESTS, f"{number:012d}.json"))


def commit(spark: SparkSession, root: str, change: Callable[[dict[str, Any] | None], dict[str, Any]]) -> int:
    """Commit what ``change`` makes of the newest manifest; it is called again if another writer was first."""
    files = Hadoop(spark, root)
    files.fs.mkdirs(files.below(_MANIFESTS))
    for _ in range(TRIES):
        known = generations(spark, root)
        number = known[-1] + 1 if known else 0
        manifest = change(current(spark, root, known[-1]) if known else None)
        if files.put_if_absent(json.dumps(manifest, sort_keys=True), _MANIFESTS, f"{number:012d}.json"):
            return number
    raise OSError(f"other writers were always first at {root}")


def vacuum(spark: SparkSession, root: str, folders: Callable[[dict[str, Any]], set[str]], within: str = "",
           keep: int = 2) -> list[str]:
    """Forget all but the newest ``keep`` generations and delete what only those forgotten list.

    ``folders`` names a manifest's folders in ``within``.  For times without writers: what a running job
    has written and not committed goes too.
    """
    if keep < 1:
        raise ValueError("keep must be 1 or more")
    files, known = Hadoop(spark, root), generations(spark, root)
    used: set[str] = set()
    for number in known[-keep:]:
        used |= folders(current(spark, root, number) or {})
    for number in known[:-keep]:
        files.drop(_MANIFESTS, f"{number:012d}.json")
    parts = [within] if within else []
    gone = [n for n in files.names(*parts) if n not in used and n != _MANIFESTS]
    for name in gone:
        files.drop(*parts, name)
    return gone
