"""Models by name (H7): versions in the shared folder, one pointer per name.

``<path>/<name>/...-v<version>.model`` holds a pickled function that maps an array
(n, 72, 24) to (n, 24).  A version's file is created, never changed: of two
publishers that ask for the same version one gets it and the other takes the
next.  ``<path>/<name>/current`` names the version in use; it is replaced by an
atomic rename, so readers see the old or the new version and nothing between.

``ship`` resolves the names once a job and hands the files to the executors,
which fetch each at most once; a Python worker loads a model when a request
first names it and keeps the ``LOADED`` used last.  What the driver holds is a
row per name; model files travel as files.
"""

from __future__ import annotations

import re
import zlib
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import SparkSession

LOADED = 8
_KEPT: OrderedDict[str, Callable] = OrderedDict()


@dataclass(frozen=True)
class Shipped:
    """Models of one job: name -> file at the executors."""
    files: dict[str, str]

    def model(self, name: str | None) -> Callable[[np.ndarray], np.ndarray] | None:
        file = self.files.get(name) if isinstance(name, str) else None
        if file is None:
            return None
        if file not in _KEPT:
            with open(SparkFiles.get(file), "rb") as held:
                _KEPT[file] = cloudpickle.loads(held.read())
            while len(_KEPT) > LOADED:
                _KEPT.popitem(last=False)
        _KEPT.move_to_end(file)
        return _KEPT[file]


class ModelRegistry:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        return self._hadoop.fs.Path("/".join((self.path, *parts)))

    def _file(self, name: str, version: int):
        """A file's name tells registries, models and versions apart, as all
        files of an application lie in one folder at an executor."""
        return self._at(name, f"{zlib.crc32(self.path.encode()):08x}-{name}-v{version}.model")

    def _fs(self):
        return self._at("x").getFileSystem(self._conf)

    def _create(self, path, data: bytes) -> None:
        out = self._fs().create(path, False)          # fails where the file exists
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def versions(self, name: str) -> list[int]:
        folder, fs = self._at(name), self._fs()
        if not fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(folder))
        return sorted(int(m.group(1)) for n in names if (m := re.fullmatch(r".*-v(\d+)\.model", n)))

    def publish(self, name: str, predict: Callable[[np.ndarray], np.ndarray]) -> int:
        """Store ``predict`` as the next version of ``name`` and use it."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
            raise ValueError(f"not a model name: {name!r}")
        data = cloudpickle.dumps(predict)
        while True:
            version = max(self.versions(name), default=0) + 1
            target = self._file(name, version)
            try:
                self._create(target, data)
                break
            except Exception:
                if not self._fs().exists(target):
                    raise
        self.use(name, version)
        return version

    def use(self, name: str, version: int) -> None:
        """Switch ``name`` to a stored version."""
        if version not in self.versions(name):
            raise ValueError(f"{name} has no version {version}")
        new = self._at(name, f"current-{version}.new")
        if self._fs().exists(new):
            self._fs().delete(new, False)
        self._create(new, str(version).encode())
        files = self._hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf) if new.toUri().getScheme() \
            else self._hadoop.fs.FileContext.getFileContext(self._conf)
        how = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        how[0] = self._hadoop.fs.Options.Rename.OVERWRITE
        files.rename(new, self._at(name, "current"), how)

    def current(self) -> dict[str, int]:
        """Version in use by name (a row per name)."""
        fs, out = self._fs(), {}
        if not fs.exists(self._hadoop.fs.Path(self.path)):
            return out
        for s in fs.listStatus(self._hadoop.fs.Path(self.path)):
            name = s.getPath().getName()
            pointer = self._at(name, "current")
            if s.isDirectory() and fs.exists(pointer):
                stream = fs.open(pointer)
                try:
                    out[name] = int(bytes(stream.readNBytes(32)).decode())
                finally:
                    stream.close()
        return out

    def ship(self) -> Shipped:
        """The models in use now, for one job."""
        files = {}
        for name, version in self.current().items():
            path = self._file(name, version)
            self.spark.sparkContext.addFile(self._fs().makeQualified(path).toString())
            files[name] = path.getName()
        return Shipped(files)
