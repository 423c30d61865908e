"""Fold micro-batches of orders into per-customer cohort state.

Each batch writes only its own delta, under its batch id, in the shared
checkpoint folder - so a batch costs O(batch), not O(state):

* ``keys``   (customer, first_ts, cohort_id): the batch's earliest purchase
             text and month per customer
* ``ties``   (customer, first_ts, attrs..., __w): the batch's orders at that
             batch-local first instant, as attribute rows with counts
* ``months`` (customer, order_month): the batch's active months

The reader folds all complete deltas with the same aggregations as the batch
operators: ``min`` over the keys, the tie rows whose instant is the global
first instant (summing their weights across batches), ``distinct`` months.
A batch-local first instant later than the global one contributes nothing,
so the fold is exact.  ``keys`` is written last and marks a delta complete;
a replayed batch (after a failure) overwrites its own delta, so it is folded
in once; a restarted driver finds the complete deltas on disk.

``compact()`` folds everything so far into a base snapshot (written under
the newest batch id, ``keys`` last); readers then take the newest base plus
the deltas after it, so read cost stays O(state + recent batches).  It runs by
itself after every ``compact_every`` deltas.  Deltas at or before a base are no
longer read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.operators.clean import clean_orders
from retentio.operators.cohort import activity_from_weighted, counts_from_weighted
from retentio.schema import FIRST_ORDER_ATTRS
from retentio.session import scratch_path


class CohortState:
    def __init__(self, spark: SparkSession, lookup: DataFrame, cutoff: str | None = None,
                 attrs: list[str] | None = None, root: str | None = None, compact_every: int = 64):
        self.spark = spark
        self.lookup = lookup
        self.cutoff = cutoff
        self.compact_every = compact_every
        self.attrs = list(FIRST_ORDER_ATTRS if attrs is None else attrs)
        self.root = root or scratch_path(spark, "cohort-state")
        self.versions: list[int] = self._complete("v")
        bases = self._complete("base")
        self.base: int | None = bases[-1] if bases else None

    @property
    def version(self) -> int | None:
        return self.versions[-1] if self.versions else None

    def _path(self, batch_id: int, name: str, kind: str = "v") -> str:
        return f"{self.root}/{kind}{batch_id:09d}/{name}"

    def _complete(self, kind: str) -> list[int]:
        """Ids of the deltas (``v``) or bases (``base``) whose ``keys`` was
        committed: the folder holds ``_SUCCESS``.  Only a missing root means
        that nothing was written yet; any other error is raised."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}*/keys/_SUCCESS"))
        return sorted(int(m.group(1)) for f in found
                      if (m := re.search(rf"/{kind}(\d{{9}})/keys/_SUCCESS$", f.getPath().toString())))

    def merge_batch(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` body: clean the new orders, write the batch's delta."""
        df = clean_orders(batch, self.lookup, self.cutoff)
        a = self.attrs
        # four tables are made from the cleaned batch: clean it once
        rows = df.select("customer", F.col("date_purchased").alias("first_ts"), "order_month", *a).persist()
        keys = rows.groupBy("customer").agg(F.min("first_ts").alias("first_ts"),
                                            F.min("order_month").alias("cohort_id"))
        ties = (rows.join(keys.select("customer", "first_ts"), ["customer", "first_ts"], "left_semi")
                    .groupBy("customer", "first_ts", *a).agg(F.count(F.lit(1)).alias("__w")))
        months = rows.select("customer", "order_month").distinct()
        for name, frame in (("months", months), ("ties", ties), ("keys", keys)):
            frame.write.mode("overwrite").parquet(self._path(batch_id, name))
        rows.unpersist()
        self.versions = sorted(set(self.versions) | {batch_id})
        if sum(self.base is None or v > self.base for v in self.versions) >= self.compact_every:
            self.compact()

    def _read_all(self, name: str) -> DataFrame:
        # at most ``compact_every`` deltas and one base
        paths = [self._path(v, name) for v in self.versions
                 if self.base is None or v > self.base]
        if self.base is not None:
            paths.append(self._path(self.base, name, "base"))
        return self.spark.read.parquet(*paths)

    def _fold(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Current (keys, ties, months): all live deltas folded exactly."""
        a = self.attrs
        keys = (self._read_all("keys").groupBy("customer")
                .agg(F.min("first_ts").alias("first_ts"), F.min("cohort_id").alias("cohort_id")))
        ties = (self._read_all("ties").join(keys.select("customer", "first_ts"),
                                            ["customer", "first_ts"], "left_semi")
                .groupBy("customer", "first_ts", *a).agg(F.sum("__w").alias("__w")))
        months = self._read_all("months").distinct()
        return keys, ties, months

    def compact(self) -> None:
        """Write the folded state as a base under the newest batch id."""
        if not self.versions:
            return
        top = self.versions[-1]
        keys, ties, months = self._fold()
        for name, frame in (("months", months), ("ties", ties), ("keys", keys)):
            frame.write.mode("overwrite").parquet(self._path(top, name, "base"))
        self.base = top

    def cohort_tables(self) -> tuple[DataFrame, DataFrame]:
        """(cohort_activity, cohort_counts) of every batch folded so far."""
        keys, ties, months = self._fold()
        weighted = (ties.join(keys, ["customer", "first_ts"])
                    .select("customer", "cohort_id", *self.attrs, "__w"))
        return (activity_from_weighted(months, weighted, self.attrs),
                counts_from_weighted(weighted, self.attrs))


def start_cohort_stream(orders_stream: DataFrame, state: CohortState,
                        checkpoint: str | None = None, available_now: bool = True):
    """Run the fold as a streaming query (``foreachBatch``); returns the query."""
    checkpoint = checkpoint or scratch_path(state.spark, "cohort-stream-ckpt")
    w = (orders_stream.writeStream.foreachBatch(state.merge_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
