"""Tables with keys, kept in hash buckets: a merge rewrites the buckets that it touches and no others.

``<path>/run=<id>/bucket=<n>`` holds a bucket as a run wrote it; the log's last entry says
which run's folder is live for each bucket, so a reader opens just those and a merge shows at
once or not at all.  Two merges of one table at a time end in order: the second finds its
version taken and, if the other touched a bucket of its own, reads those and merges anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from packloom import files
from packloom.storage import stored

BUCKETS = 64


class Keyed:
    """A table at ``path`` with these key columns; ``buckets`` counts for the first merge only and then stays."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def read(self, only: set[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The live rows (of some buckets); None where nothing was ever merged."""
        state = files.entry(self.spark, self.path, version)[1]
        return self._rows(state, only) if state else None

    def _rows(self, state: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        paths = [f"{self.path}/run={run}/bucket={b}" for b, run in state["live"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def merge(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Rows of new keys are added, those of known keys replace theirs, keys in ``gone`` go; returns the version.

        Keys are distinct within ``rows``; null is a key value like others.  All columns are given each
        time, in any order; the first merge sets their types.
        """
        new = stored(rows)
        out = None if gone is None else stored(gone.select(*self.keys))
        while True:
            version, state = files.entry(self.spark, self.path)
            buckets = state.get("buckets", self.buckets)
            schema = StructType.fromJson(state["schema"]) if state else new.schema
            own = self.bucket(buckets)
            keys = new.select(*self.keys) if out is None else new.select(*self.keys).unionByName(out)
            touched = {r[0] for r in keys.select(own.alias("b")).distinct().collect()}  # at most ``buckets``
            if not touched and state:
                return version
            run, live = uuid.uuid4().hex, dict(state.get("live", {}))
            made = new.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
            if state and any(str(b) in live for b in touched):
                marks = keys.distinct().select(*[F.col(k).alias(f"_{k}") for k in self.keys])
                same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
                made = self._rows(state, touched).join(marks.hint("shuffle_merge"), same, "left_anti").unionByName(made)
            made.withColumn("bucket", own).repartition("bucket").sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{self.path}/run={run}")
            for b in touched:
                live.pop(str(b), None)
            written = {int(n.removeprefix("bucket=")) for n in files.names_in(self.spark, f"{self.path}/run={run}") if n.startswith("bucket=")}
            live |= {str(b): run for b in written}
            while True:
                try:
                    files.publish(self.spark, self.path, version + 1, {"buckets": buckets, "schema": schema.jsonValue(), "live": live})
                    return version + 1
                except files.Taken:
                    version, now = files.entry(self.spark, self.path)
                    if now["buckets"] != buckets or any(now["live"].get(str(b)) != state.get("live", {}).get(str(b)) for b in touched):
                        break  # another run changed a bucket of ours: merge with what it left
                    live = {b: r for b, r in now["live"].items() if int(b) not in touched} | {b: r for b, r in live.items() if int(b) in touched}
            files.delete(self.spark, f"{self.path}/run={run}")

    def clean(self, keep: int = 1) -> list[str]:
        """Forget all but the last ``keep`` versions and remove the bucket folders that only those held; returns what was removed."""
        have = files.versions(self.spark, self.path)
        old, kept = have[:-keep], have[-keep:]
        folders = lambda vs: {f"run={run}/bucket={b}" for v in vs for b, run in files.entry(self.spark, self.path, v)[1]["live"].items()}
        dead = sorted(folders(old) - folders(kept))
        for v in old:
            files.delete(self.spark, files.entry_path(self.path, v))
        for folder in dead:
            files.delete(self.spark, f"{self.path}/{folder}")
        return dead
