"""Results kept for a while: a table for each request, in a folder of any file system that Spark reaches."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: seconds that a result stays fresh.
TTL_S = 3600


class ResultCache:
    """Results by request (anything that JSON can hold). A result is written before it is used, and a new one
    lies beside the old one, so readers of that are not disturbed."""

    def __init__(self, spark: SparkSession, folder: str, ttl_s: float = TTL_S):
        self.spark, self.folder, self.ttl_s = spark, folder.rstrip("/"), ttl_s

    def _system(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _made(self, base: str) -> list[tuple[float, str]]:
        """Time and path of the whole results below a folder, the newest first."""
        system, target = self._system(base)
        if not system.exists(target):
            return []
        found = []
        for status in system.listStatus(target):
            path = status.getPath().toString()
            done_in, done = self._system(f"{path}/_SUCCESS")
            if done_in.exists(done):
                found.append((done_in.getFileStatus(done).getModificationTime() / 1000, path))
        return sorted(found, reverse=True)

    def get(self, request: object, make: Callable[[], DataFrame]) -> DataFrame:
        """The request's fresh result, or else one that ``make`` gives."""
        key = hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()
        made = self._made(f"{self.folder}/{key}")
        if made and time.time() - made[0][0] < self.ttl_s:
            return self.spark.read.parquet(made[0][1])
        path = f"{self.folder}/{key}/{uuid.uuid4().hex}"
        make().write.parquet(path)
        return self.spark.read.parquet(path)

    def expire(self) -> int:
        """Deletes results that are not fresh any more; how many."""
        system, target = self._system(self.folder)
        gone = 0
        for request in system.listStatus(target) if system.exists(target) else []:
            for when, path in self._made(request.getPath().toString()):
                if time.time() - when >= self.ttl_s:
                    gone += bool(self._system(path)[0].delete(self._system(path)[1], True))
        return gone
