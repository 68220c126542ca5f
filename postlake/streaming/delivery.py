"""Live delivery: clients with bounded queues, and numbers of events that go on across micro-batches."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from postlake.operators import states
from postlake.streaming.folds import Fold

CLIENTS, QUEUE = 200, 200


def hub(clients: int = CLIENTS, queue: int = QUEUE) -> Fold:
    """What an instance does with its clients and events, over rows in order of time.

    Rows have kind, client (a string), workspace_id, sources (array) and n. ``connect`` admits a client with its audience, if fewer than ``clients`` are
    connected (one that's connected already starts anew); ``disconnect`` lets it go; ``take`` has it read up to n events from its queue. An ``event`` (with
    a workspace, or else a source of followers in ``sources``) goes to the queues of the clients that may see it; a client whose queue is full is dropped and
    gives its place up. The state is one short list per instance: ``clients`` entries at most, whatever the number of events.
    """

    def sees(client: dict, row: dict) -> bool:
        if row["workspace_id"] is not None and row["workspace_id"] == row["workspace_id"]:
            return client["workspace"] == row["workspace_id"]
        return bool(set(client["sources"]) & set([] if row["sources"] is None else row["sources"]))

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        held: dict[str, dict] = json.loads(state[0])
        kind, client = row["kind"], str(row["client"])
        admitted, delivered, dropped = None, 0, []
        if kind == "connect":
            admitted = client in held or len(held) < clients
            if admitted:
                held[client] = {"workspace": None if row["workspace_id"] != row["workspace_id"] else row["workspace_id"], "sources": [] if row["sources"] is None else list(row["sources"]), "queued": 0}
        elif kind == "disconnect":
            held.pop(client, None)
        elif kind == "take" and client in held:
            delivered = min(held[client]["queued"], int(row["n"]))
            held[client]["queued"] -= delivered
        elif kind == "event":
            for name in sorted(held):
                if sees(held[name], row):
                    if held[name]["queued"] >= queue:
                        dropped.append(name)
                        del held[name]
                    else:
                        held[name]["queued"] += 1
                        delivered += 1
        return (json.dumps(held),), {"admitted": admitted, "delivered": delivered, "dropped": dropped, "connected": len(held)}

    return Fold("admitted boolean, delivered int, dropped array<string>, connected int", "clients string", ("{}",), step)


#: Batches from one full copy of the counters to the next.
FULL_EVERY = 16


class NumberedSink:
    """A ``foreachBatch`` sink that numbers the events of each key without gaps, from 1, over all micro-batches of a stream.

    ``audience`` gives the followed sources (source_id) anew for every micro-batch. Each batch leaves its numbered events and the counters of its own keys under
    its number; a batch that comes again, after a restart, starts from the counters of those before it and so gives the
    same numbers. Now and then all counters are copied, so no batch reads more than the last copy and a few batches.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, order: list[str], audience: Callable[[], DataFrame], workspace: object):
        self.spark, self.folder, self.key, self.order, self.audience, self.workspace = spark, folder, key, order, audience, workspace

    def _counters(self, batch: int) -> DataFrame:
        """(key, last): the counters after all batches before ``batch``."""
        start = (batch - 1) // FULL_EVERY * FULL_EVERY
        found = None
        for n in range(max(0, start), batch):
            try:
                rows = self.spark.read.parquet(f"{self.folder}/counters/{n}")
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            return self.spark.createDataFrame([], "key string, last long")
        return found.groupBy("key").agg(F.max("last").alias("last"))

    def __call__(self, events: DataFrame, batch: int) -> None:
        key = F.col(self.key).cast("string")
        before = self._counters(batch).select(F.col("key").alias("_key"), F.col("last").alias("_last"))
        routed = states.routed(events, self.audience(), self.workspace).withColumn("_key", key)
        place = F.row_number().over(Window.partitionBy("_key").orderBy(*self.order))
        numbered = routed.withColumn("_place", place).join(before, "_key", "left").withColumn("number", F.coalesce("_last", F.lit(0)) + F.col("_place"))
        numbered.drop("_key", "_place", "_last").write.mode("overwrite").parquet(f"{self.folder}/events/batch={batch}")
        seen = self.spark.read.parquet(f"{self.folder}/events/batch={batch}").groupBy(key.alias("key")).agg(F.max("number").alias("last"))
        if batch % FULL_EVERY == 0:
            seen = seen.union(before).groupBy("key").agg(F.max("last").alias("last"))
        seen.write.mode("overwrite").parquet(f"{self.folder}/counters/{batch}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/events").drop("batch")
