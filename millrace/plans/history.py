"""A history table kept as versioned parquet folders.

Layout under the table's folder::

    data/v=<version>/b=<bucket>/*.parquet     rows, by hash bucket of the keys
    commits/<version>[.<batch id>]/           which data version holds each bucket
    applied/<batch id>/                       batches whose commits were pruned

A merge reads and rewrites only the buckets its batch touches. Data files are written
first and the commit folder last; a reader trusts only commits with ``_SUCCESS``, so a
failed or repeated write changes nothing. Older versions stay readable. One writer at a
time per table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import MissingTable
from millrace.operators.latest import keep_latest
from millrace.session import written_table

_BUCKET = "__bucket"
_STAGED = "staged"


# A bucket is meant to be rewritten by one task, so it should stay near this size on disk.
BUCKET_BYTES = 512 * 1024 * 1024


class Commit(NamedTuple):
    version: int
    batch_id: str | None
    path: str


class State(NamedTuple):
    version: int
    schema: T.StructType
    keys: list[str]
    buckets: int
    n_bytes: int
    data_versions: dict[int, int]


class History:
    """Rows accumulated over runs: the latest row per key.

    ``buckets`` None lets the table grow its own: one while it is small, then twice as
    many whenever buckets outgrow ``BUCKET_BYTES``. A given number is doubled likewise for
    as long as the table is too large for it. Changing the number or the keys rewrites the
    table once.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        order_by: str,
        buckets: int | None = None,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.order_by = order_by
        self.buckets = buckets

    # -- reading ----------------------------------------------------------------

    def _hadoop(self, path: str):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def _listed(self) -> list[Commit]:
        """Commit folders, newest first, finished or not."""
        fs, folder = self._hadoop(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        found = []
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            version, _, batch_id = name.partition(".")
            found.append(Commit(int(version), batch_id or None, f"{self.path}/commits/{name}"))
        return sorted(found, reverse=True)

    def _finished(self, commit: Commit) -> bool:
        fs, marker = self._hadoop(f"{commit.path}/_SUCCESS")
        return fs.exists(marker)

    def commits(self) -> list[Commit]:
        """Committed versions, oldest first."""
        return [c for c in reversed(self._listed()) if self._finished(c)]

    def state(self, version: int | None = None) -> State | None:
        wanted = (c for c in self._listed() if version in (None, c.version))
        commit = next((c for c in wanted if self._finished(c)), None)
        if commit is None:
            if version is not None:
                raise MissingTable(f"{self.path} has no version {version}")
            return None
        # One line per bucket and one about the table: bounded by the bucket count.
        lines = self.spark.read.parquet(commit.path).collect()
        about = json.loads(next(r["about"] for r in lines if r["about"]))
        return State(
            version=commit.version,
            schema=T.StructType.fromJson(about["schema"]),
            keys=about["keys"],
            buckets=about["buckets"],
            n_bytes=about["n_bytes"],
            data_versions={r["bucket"]: r["data_version"] for r in lines if r["about"] is None},
        )

    def read(self, version: int | None = None) -> DataFrame:
        state = self.state(version)
        if state is None:
            raise MissingTable(f"no history at {self.path}")
        return self._rows(state, sorted(state.data_versions))

    def _rows(self, state: State, buckets: Sequence[int]) -> DataFrame:
        paths = [
            f"{self.path}/data/v={state.data_versions[b]}/b={b}" for b in buckets if b in state.data_versions
        ]
        if not paths:
            return self.spark.createDataFrame([], state.schema)
        return self.spark.read.schema(state.schema).parquet(*paths)

    # -- writing ----------------------------------------------------------------

    def merge(self, batch: DataFrame, batch_id: str | None = None) -> int:
        """Add a batch and return the version that holds it.

        A batch id that is already committed is not applied again.
        """
        if batch_id is not None:
            done = next((c for c in self._listed() if c.batch_id == str(batch_id) and self._finished(c)), None)
            if done:
                return done.version
        state = self.state()
        if batch_id is not None and state is not None:
            fs, applied = self._hadoop(f"{self.path}/applied/{batch_id}")
            if fs.exists(applied):
                return state.version
        version = 1 if state is None else state.version + 1
        buckets = self._bucket_count(state)
        same_layout = state is not None and (state.buckets, state.keys) == (buckets, self.keys)
        if buckets == 1:
            merged, touched = self._merge_whole(batch, state), [0]
        else:
            merged, touched = self._merge_buckets(batch, state, buckets, same_layout)

        target = f"{self.path}/data/v={version}"
        if buckets == 1:
            merged.write.mode("overwrite").parquet(f"{target}/b=0")
        else:
            merged.withColumnRenamed(_BUCKET, "b").write.mode("overwrite").partitionBy("b").parquet(target)
        data_versions = {**(state.data_versions if same_layout else {}), **{b: version for b in touched}}
        fs, folder = self._hadoop(target)
        untouched = 1 - len(touched) / max(len(data_versions), 1)
        n_bytes = fs.getContentSummary(folder).getLength() + int(state.n_bytes * untouched if same_layout else 0)
        about = {
            "schema": merged.drop(_BUCKET).schema.jsonValue(),
            "keys": self.keys,
            "buckets": buckets,
            "n_bytes": n_bytes,
        }
        self._commit(version, batch_id, about, data_versions)
        fs, staged = self._hadoop(f"{self.path}/{_STAGED}")
        fs.delete(staged, True)
        return version

    def prune(self, keep: int) -> list[int]:
        """Delete versions before the last ``keep`` and the data only they hold.

        Returns the versions deleted. Nothing is ever deleted unasked.
        """
        commits = self.commits()
        old, kept = commits[:-keep], commits[-keep:]
        needed = {v for c in kept for v in self.state(c.version).data_versions.values()}
        for commit in old:
            if commit.batch_id is not None:
                fs, applied = self._hadoop(f"{self.path}/applied/{commit.batch_id}")
                fs.mkdirs(applied)
            for folder in [commit.path] + ([f"{self.path}/data/v={commit.version}"] * (commit.version not in needed)):
                fs, path = self._hadoop(folder)
                fs.delete(path, True)
        return [c.version for c in old]

    def _bucket_count(self, state: State | None) -> int:
        if state is None:
            return self.buckets or 1
        buckets = self.buckets or state.buckets
        while state.n_bytes > buckets * BUCKET_BYTES:
            buckets *= 2
        return buckets

    def _merge_whole(self, batch: DataFrame, state: State | None) -> DataFrame:
        if state is not None:
            batch = self._rows(state, sorted(state.data_versions)).unionByName(batch, allowMissingColumns=True)
        return keep_latest(batch, self.keys, self.order_by)

    def _merge_buckets(
        self, batch: DataFrame, state: State | None, buckets: int, same_layout: bool
    ) -> tuple[DataFrame, list[int]]:
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(buckets)).cast("int")
        # With a new layout every row moves, and with new keys old rows may now share one.
        fresh = keep_latest(batch, self.keys, self.order_by) if same_layout else self._merge_whole(batch, state)
        # Read more than once below, and its source may give other rows the next time.
        fresh = written_table(fresh.withColumn(_BUCKET, bucket), f"{self.path}/{_STAGED}")
        touched = [r[0] for r in fresh.select(_BUCKET).distinct().collect()]
        if same_layout:
            if _retyped(state.schema, batch.schema):
                touched = sorted({*touched, *state.data_versions})
            before = self._rows(state, touched).withColumn(_BUCKET, bucket)
            fresh = before.unionByName(fresh, allowMissingColumns=True)
        # A key has two rows at most by now, so whole buckets can move to one task each.
        moved = fresh.repartition(max(len(touched), 1), _BUCKET)
        return keep_latest(moved, [_BUCKET, *self.keys], self.order_by), touched

    def _commit(self, version: int, batch_id: str | None, about: dict, data_versions: dict[int, int]) -> None:
        lines = [(None, None, json.dumps(about)), *[(b, v, None) for b, v in sorted(data_versions.items())]]
        name = f"{version:010d}" + (f".{batch_id}" if batch_id is not None else "")
        (
            self.spark.createDataFrame(lines, "bucket int, data_version int, about string")
            .coalesce(1)
            .write.mode("overwrite")
            .parquet(f"{self.path}/commits/{name}")
        )


def _retyped(old: T.StructType, new: T.StructType) -> bool:
    """Whether a column both sides have changed its type, so old files need rewriting."""
    before = {f.name: f.dataType for f in old.fields}
    return any(f.name in before and before[f.name] != f.dataType for f in new.fields)
