"""References to keys that no parent row holds, maintained incrementally.

A parent row makes its key valid from ``since`` (its registration less a grace) until it is deleted. The tracker's state lies in a folder, cut
into buckets by key: the parents' arrivals and deletions (the index), the references, and those of them that are orphans now. A step probes the
index with its new references, and looks again at the earlier references of just those keys whose parents changed: a parent that arrives
resolves orphans, a deletion reopens them. Arrivals are appended, orphans are rewritten for the buckets that the step touches, and a small
file that names the valid parts is replaced last; so a step that fails leaves the state as it was, and a tracker opened on the folder goes on from
there. After each step the counts per table and month are kept as its snapshot.

No key is gathered in one task: the changes of a key (+1, -1) are summed per day; references join the balance of their day and are compared with
the changes of that day only.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seston.runtime import join_sized, local_path, norm_key, scratch, settle

GRACE = "7 days"
#: Buckets of the state.
BUCKETS = 8

REFS = "tab string, key string, t timestamp_ntz, n long"
EVENTS = "row long, key string, since timestamp_ntz, until timestamp_ntz"


def parent_rows(df: DataFrame, key: str, registered: str, deleted: str, grace: str = GRACE) -> DataFrame:
    """(row, key, since, until) of parents with key and registration; without deletion ``until`` is null. ``row`` tells rows apart; rows equal in all columns are one."""
    rows = df.select(
        F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in df.columns)).alias("row"), norm_key(key).alias("key"),
        (F.col(registered) - F.expr(f"INTERVAL {grace}")).cast("timestamp_ntz").alias("since"), F.col(deleted).cast("timestamp_ntz").alias("until"),
    )
    return rows.filter("key IS NOT NULL AND since IS NOT NULL").distinct()


def reference_rows(df: DataFrame, tab: str, key: str, time: str) -> DataFrame:
    """(tab, key, t, n) of references with key and time."""
    rows = df.select(F.lit(tab).alias("tab"), norm_key(key).alias("key"), F.col(time).cast("timestamp_ntz").alias("t"))
    return rows.filter("key IS NOT NULL AND t IS NOT NULL").groupBy("tab", "key", "t").agg(F.count("*").alias("n"))


def orphans_among(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``refs`` at whose time no parent (key, since, until) of their key is valid: since <= t < until."""
    valid = parents.filter("until IS NULL OR until > since")
    changes = valid.select("key", F.col("since").alias("t"), F.lit(1).alias("d")).unionByName(valid.filter("until IS NOT NULL").select("key", F.col("until").alias("t"), F.lit(-1).alias("d")))
    changes = changes.groupBy("key", "t").agg(F.sum("d").alias("d"))
    refs = settle(refs.withColumn("day", F.to_date("t")), "asked")
    days = changes.groupBy("key", F.to_date("t").alias("day")).agg(F.sum("d").alias("d"), F.array_sort(F.collect_list(F.struct("t", "d"))).alias("moves"))
    asked = refs.groupBy("key", "day").agg(F.lit(0).cast("long").alias("d"), F.lit(None).cast(days.schema["moves"].dataType).alias("moves"))
    balance = days.unionByName(asked).groupBy("key", "day").agg(F.sum("d").alias("d"), F.max("moves").alias("moves"))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row per day at most
    balance = settle(balance.withColumn("open", F.coalesce(F.sum("d").over(before), F.lit(0))).select("key", "day", "open", "moves"), "balance")
    dated = join_sized(refs, balance, ["key", "day"])
    same_day = F.aggregate(F.filter("moves", lambda m: m["t"] <= F.col("t")), F.lit(0).cast("long"), lambda s, m: s + m["d"])
    now = F.col("open") + F.coalesce(same_day, F.lit(0))
    return dated.filter(now <= 0).select("tab", "key", "t", "n")


class OrphanTracker:
    """Pending orphans under arriving references, parents and deletions.

    ``advance`` takes tables as ``reference_rows`` and ``parent_rows`` give them; a deletion is a parent's row with ``until`` set, and ends the row of the
    same ``row``. A reference or parent without key or time is left out; rows of parents that arrive twice count once, references as often as they come;
    a deletion that arrives before its row waits for it. Any argument may be None or empty.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        """A new state, or with ``folder`` that which lies there."""
        self.spark, self.folder, self.buckets = spark, folder or scratch(spark, "orphans"), buckets
        self.state = {"step": 0, "refs": [], "events": [], "pending": {}}
        if folder is not None and os.path.exists(self._manifest()):
            with open(self._manifest()) as f:
                self.state = json.load(f)
            self.buckets = self.state["buckets"]

    def _manifest(self) -> str:
        return os.path.join(local_path(self.folder), "manifest.json")

    def _publish(self, state: dict) -> None:
        os.makedirs(local_path(self.folder), exist_ok=True)
        made = f"{self._manifest()}.{uuid.uuid4().hex}"
        with open(made, "w") as f:
            json.dump(state | {"buckets": self.buckets}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(made, self._manifest())
        self.state = state

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:12]}"
        placed = df.withColumn("bucket", self._bucket())
        placed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)  # splits a bucket that is large, joins what is small
        return path

    def _read(self, paths: list[str], schema: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of tables, of some buckets only: the others' files aren't touched."""
        empty = self.spark.createDataFrame([], schema)
        out = empty
        for p in paths:
            part = self.spark.read.schema(f"{schema}, bucket int").parquet(p)
            if buckets is not None:
                part = part.filter(F.col("bucket").isin(buckets))
            out = out.unionByName(part.select(empty.columns))
        return out

    def _pending(self, buckets: list[int] | None = None) -> DataFrame:
        at: dict[str, list[int]] = {}
        for b, p in self.state["pending"].items():
            if buckets is None or int(b) in buckets:
                at.setdefault(p, []).append(int(b))
        out = self.spark.createDataFrame([], REFS)
        for p, bs in at.items():
            out = out.unionByName(self._read([p], REFS, bs))
        return out

    def advance(self, refs: DataFrame | None = None, parents: DataFrame | None = None, deletions: DataFrame | None = None) -> OrphanTracker:
        new_refs = settle((refs if refs is not None else self.spark.createDataFrame([], REFS)).select("tab", "key", "t", "n"), "refs-new")
        none = self.spark.createDataFrame([], EVENTS)
        arrived = (parents if parents is not None else none).select("row", "key", "since", "until")
        ended = (deletions if deletions is not None else none).filter("until IS NOT NULL").select("row", "key", F.lit(None).cast("timestamp_ntz").alias("since"), "until")
        events = settle(arrived.unionByName(ended), "events-new")
        changed = events.select("key").distinct()
        seen = new_refs.select(self._bucket(), F.lit(False).alias("c")).union(changed.select(self._bucket(), F.lit(True))).groupBy("bucket").agg(F.max("c").alias("c")).collect()  # a row a bucket
        touched, hit = sorted(r["bucket"] for r in seen), sorted(r["bucket"] for r in seen if r["c"])
        if not touched:
            return self
        state = json.loads(json.dumps(self.state))
        state["step"] += 1
        # earlier references of keys whose parents changed, and the new ones
        again = self._read(state["refs"], REFS, hit).join(changed, "key", "left_semi") if hit else self.spark.createDataFrame([], REFS)
        look = again.unionByName(new_refs).groupBy("tab", "key", "t").agg(F.sum("n").alias("n"))
        state["events"].append(self._write(events, "events"))
        state["refs"].append(self._write(new_refs, "refs"))
        index = self._read(state["events"], EVENTS, touched).groupBy("row", "key").agg(F.min("since").alias("since"), F.min("until").alias("until")).filter("since IS NOT NULL")
        orphans = orphans_among(look, index)
        rest = self._pending(touched).join(changed, "key", "left_anti")
        pending = self._write(rest.unionByName(orphans).groupBy("tab", "key", "t").agg(F.sum("n").alias("n")), "pending")
        state["pending"] |= {str(b): pending for b in touched}
        self._publish(state)
        snapshot = f"{self.folder}/snapshots/step={state['step']}"
        self.report().groupBy("tab", "yyyymm").agg(F.sum("n").alias("n"), F.count("*").alias("n_keys")).coalesce(1).write.mode("overwrite").parquet(snapshot)
        return self

    @property
    def pending(self) -> DataFrame:
        return self._pending()

    def report(self) -> DataFrame:
        """tab, yyyymm, key, number of orphan references: the state of this moment."""
        month = F.date_format("t", "yyyyMM").cast("int")
        return self.pending.groupBy("tab", month.alias("yyyymm"), "key").agg(F.sum("n").alias("n"))

    def snapshots(self) -> DataFrame:
        """step, tab, yyyymm, n and n_keys after each step."""
        if not self.state["step"]:
            return self.spark.createDataFrame([], "tab string, yyyymm int, n long, n_keys long, step int")
        return self.spark.read.schema("tab string, yyyymm int, n long, n_keys long, step int").parquet(f"{self.folder}/snapshots")
