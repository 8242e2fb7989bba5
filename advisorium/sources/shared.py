"""Small marker files in a folder that all writers share; each is created whole or not at all."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class SharedFolder:
    """Files by name below ``folder``, on any file system that Hadoop reads.

    A file is written beside and then takes its name only if that is free, so a writer that is lost in between leaves
    the name free and of two writers exactly one wins. On a local disk the name is taken by a hard link, elsewhere by
    a rename that does not overwrite; the file system must do that in one step, as HDFS does. Local files are reached
    directly, since a call into the JVM for each marker would cost more than the marker.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        context = spark.sparkContext
        self._jvm, self._conf = context._jvm, context._jsc.hadoopConfiguration()
        at = self._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = at.getFileSystem(self._conf)
        self._disk = unquote(urlparse(self._fs.makeQualified(at).toUri().toString()).path) if self._fs.getScheme() == "file" else None

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def create_once(self, name: str, content: dict) -> bool:
        """Create a file that must not exist; False if it does, whoever made it."""
        text = json.dumps(content).encode()
        return self._link(f"{self._disk}/{name}", text) if self._disk else self._rename(self._at(name), text)

    def _link(self, final: str, text: bytes) -> bool:
        os.makedirs(os.path.dirname(final), exist_ok=True)
        beside = f"{os.path.dirname(final)}/.{uuid.uuid4().hex}"
        try:
            with open(beside, "wb") as f:
                f.write(text)
            try:
                os.link(beside, final)
            except PermissionError:  # a disk without hard links: the name is taken first and then filled
                with open(final, "xb") as f:
                    f.write(text)
        except FileExistsError:
            return False
        finally:
            if os.path.exists(beside):
                os.unlink(beside)
        return True

    def _rename(self, target, text: bytes) -> bool:
        from py4j.protocol import Py4JJavaError

        if self._fs.exists(target):
            return False
        beside = self._at(f".beside/{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(text))
        stream.close()
        self._fs.mkdirs(target.getParent())
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            files.rename(self._fs.makeQualified(beside), self._fs.makeQualified(target), none)
        except Py4JJavaError as e:
            self._fs.delete(beside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def names(self, folder: str) -> list[str]:
        """Names below ``folder``, sorted; unfinished files are left out."""
        if self._disk:
            at = f"{self._disk}/{folder}"
            found = os.listdir(at) if os.path.isdir(at) else []
        else:
            at = self._at(folder) if folder else self._jvm.org.apache.hadoop.fs.Path(self.folder)
            found = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in found if not n.startswith("."))

    def load(self, name: str) -> dict | None:
        """Content of a file; None if it is absent or a writer was lost before any content was there."""
        if self._disk:
            try:
                with open(f"{self._disk}/{name}", encoding="utf-8") as f:
                    text = f.read()
            except FileNotFoundError:
                return None
        else:
            at = self._at(name)
            if not self._fs.exists(at):
                return None
            stream = self._fs.open(at)
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
        return json.loads(text) if text.strip() else None

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Pointer:
    """A chain of numbered states, of which the last counts; a swap names the number it was drawn up against.

    Of two writers that read the same state one gets the next number and the other an error, so nothing is lost.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.files = SharedFolder(spark, f"{folder.rstrip('/')}/_states")

    def read(self) -> tuple[int, dict]:
        """(number, state); (0, {}) before the first."""
        for name in reversed(self.files.names("")):
            if name.isdigit() and (state := self.files.load(name)) is not None:
                return int(name), state
        return 0, {}

    def swap(self, expected: int, state: dict) -> int:
        """Let ``state`` follow number ``expected``."""
        at = expected + 1
        name = f"{at:012d}"
        if self.read()[0] != expected or not self.files.create_once(name, state):
            raise StaleState(f"{self.files.folder}: another writer came after state {expected}")
        return at


class StaleState(Exception):
    """What a writer read is no longer what counts."""
