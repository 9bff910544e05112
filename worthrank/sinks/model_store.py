"""K5: models saved only when they improve, by a commit that neither a retry nor a second writer can spoil.

A store is a folder on shared storage. A model is written whole under ``versions/<version>``; what counts is the highest
numbered record in ``commits``, a small file that names version and metric. A record is made by creating its file, which
fails if another writer was first: the loser looks again whether its model is still the better one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import SparkSession


class ModelStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _records(self) -> list[tuple[int, dict]]:
        """(number, record) in the order of the commits; records cut off while they were written don't count."""
        folder = self._of(f"{self.path}/commits")
        out = []
        if self._fs.exists(folder):
            for status in self._fs.listStatus(folder):
                name = status.getPath().getName()
                stream = self._fs.open(status.getPath())
                try:
                    held = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                try:
                    out.append((int(name.removesuffix(".json")), json.loads(held)))
                except ValueError:
                    out.append((int(name.removesuffix(".json")), {}))
        return sorted(out, key=lambda x: x[0])

    def current(self) -> dict | None:
        """The record that counts: ``version`` and ``metric``."""
        held = [r for _, r in self._records() if r]
        return held[-1] if held else None

    def current_path(self) -> str | None:
        now = self.current()
        return None if now is None else f"{self.path}/versions/{now['version']}"

    def offer(self, version: str, metric: float, write: Callable[[str], None]) -> bool:
        """Save the model that ``write`` writes to a path if ``metric`` is above the current one; whether it was saved. A version
        that has been committed is not written again. Nothing is written for a model that is no better (or whose metric is NaN)."""
        written = False
        while True:
            records = self._records()
            if any(r.get("version") == version for _, r in records):
                return True
            now = next((r for _, r in reversed(records) if r), None)
            if math.isnan(metric) or now is not None and not metric > now["metric"]:
                return False
            if not written:
                write(f"{self.path}/versions/{version}")
                written = True
            if self._commit(records[-1][0] + 1 if records else 0, {"version": version, "metric": metric}):
                return True

    def _commit(self, number: int, record: dict) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            stream = self._fs.create(self._of(f"{self.path}/commits/{number:010d}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()) or "already exists" in str(e.java_exception.getMessage()):
                return False
            raise
        try:
            stream.write(bytearray(json.dumps(record).encode()))
        finally:
            stream.close()
        return True
