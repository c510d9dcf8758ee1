"""Small files on any file system Spark can reach, by the Hadoop interface: markers, locks and heads of tables."""

from __future__ import annotations

from pyspark.sql import SparkSession


_systems: dict[tuple, object] = {}


class Shared:
    """Reads and writes small texts below one session's file systems."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway, self._app = spark.sparkContext._gateway, spark.sparkContext.applicationId

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        uri = where.toUri()
        key = (self._app, uri.getScheme(), uri.getAuthority())
        if key not in _systems:
            # An instance of its own: a local file that something else has replaced has no checksum of ours.
            _systems[key] = self._jvm.org.apache.hadoop.fs.FileSystem.newInstance(uri, self._conf)
            _systems[key].setVerifyChecksum(False)
            _systems[key].setWriteChecksum(False)
        return _systems[key], where

    def exists(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where)

    def read(self, path: str) -> str | None:
        """The text of a file, or None where there is none."""
        system, where = self._at(path)
        if not system.exists(where):
            return None
        stream = system.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, new_only: bool = False) -> bool:
        """Writes a text; with ``new_only`` not over a file that is there, and tells whether it was written."""
        system, where = self._at(path)
        try:
            stream = system.create(where, not new_only)
        except Exception as e:  # noqa: BLE001
            if new_only and "lready exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
            if hasattr(stream, "hsync"):
                stream.hsync()
        finally:
            stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Writes a text beside and renames it over the old one, so that it is there whole or not at all."""
        self.write(path + ".tmp", text)
        names = self._jvm.org.apache.hadoop.fs
        source, target = names.Path(path + ".tmp"), names.Path(path)
        overwrite = self._gateway.new_array(getattr(names, "Options$Rename"), 1)
        overwrite[0] = getattr(names, "Options$Rename").OVERWRITE
        context = names.FileContext.getFileContext(target.getFileSystem(self._conf).getUri(), self._conf)
        context.rename(context.makeQualified(source), context.makeQualified(target), overwrite)

    def delete(self, path: str) -> None:
        system, where = self._at(path)
        system.delete(where, True)
