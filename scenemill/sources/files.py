"""Small files and renames through Hadoop's file system, so that any store Spark reads will do."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """Reading, writing, renaming and removing by path, on the driver."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple[Any, Any]:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"{old} can't be renamed to {new}")

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The whole file or none: written beside its place, read back, and renamed."""
        fs, p = self._at(path)
        aside = f"{path}.writing"
        stream = fs.create(self.jvm.org.apache.hadoop.fs.Path(aside), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        if self.read(aside) != text:
            raise OSError(f"{aside} doesn't hold what was written")
        if fs.exists(p):
            fs.delete(p, False)
        self.rename(aside, path)

    def write_json(self, path: str, document: Any) -> None:
        text = json.dumps(document, indent=2, sort_keys=True, allow_nan=False)
        if json.loads(text) != document:
            raise ValueError("the document changes when it is written as JSON")
        self.write(path, text + "\n")

    def sha256(self, path: str) -> str:
        return hashlib.sha256(self.read(path).encode()).hexdigest()


#: Names of the markers that say a stage's output is whole, cleanly or with reservations.
CLEAN, DEGRADED = "_DONE", "_DONE.degraded"


def clear_markers(files: Files, folder: str) -> None:
    for name in (CLEAN, DEGRADED):
        files.remove(f"{folder}/{name}")


def write_marker(files: Files, folder: str, fingerprint: str, causes: list[str] | None = None) -> None:
    """One marker, bound to the metadata's fingerprint; with causes it says that the output is degraded, and why."""
    if not fingerprint:
        raise ValueError("a marker needs the fingerprint of the metadata")
    clear_markers(files, folder)
    files.write_json(f"{folder}/{DEGRADED if causes else CLEAN}", {"fingerprint": fingerprint, "causes": causes or []})


def read_marker(files: Files, folder: str) -> dict | None:
    """state (clean or degraded), fingerprint and causes; None means that the output isn't whole."""
    for name, state in ((CLEAN, "clean"), (DEGRADED, "degraded")):
        if files.exists(f"{folder}/{name}"):
            return {"state": state} | json.loads(files.read(f"{folder}/{name}"))
    return None


def required_upstream(files: Files, folder: str, fingerprint: str, degraded_ok: bool = False) -> dict:
    """The marker of a stage's output, which must be whole, of this metadata and, unless allowed, not degraded."""
    found = read_marker(files, folder)
    if found is None:
        raise ValueError(f"{folder} isn't whole")
    if found["fingerprint"] != fingerprint:
        raise ValueError(f"{folder} was made of other metadata")
    if found["state"] == "degraded" and not degraded_ok:
        raise ValueError(f"{folder} is degraded: {', '.join(found['causes'])}")
    return found


def resumed(files: Files, folders: dict[str, str], fingerprint: str) -> dict[str, str]:
    """What to do with each named piece of work: skip (whole, of this metadata) or run."""
    found = {n: read_marker(files, f) for n, f in folders.items()}
    return {n: "skip" if m and m["fingerprint"] == fingerprint else "run" for n, m in found.items()}
