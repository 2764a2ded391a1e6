"""The set of closed junctions as a stream of events: an event replaces the whole set, the last one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "graph_id string, at timestamp, nodes array<long>"


def current_closures(events: DataFrame) -> DataFrame:
    """(graph_id, at, nodes) after all of ``events(graph_id, at, action, nodes)``: ``close`` sets the nodes, ``reset`` empties them; of events at one time the longest list, then the greatest, stands."""
    nodes = F.when(F.col("action") == "close", F.sort_array(F.array_distinct(F.coalesce("nodes", F.array().cast("array<long>"))))).otherwise(F.array().cast("array<long>"))
    last = events.groupBy("graph_id").agg(F.max_by(F.struct("at", nodes.alias("nodes")), F.struct("at", F.size(nodes), nodes)).alias("s"))
    return last.select("graph_id", "s.at", "s.nodes")


def closure_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same over a streaming ``events``, one state a graph, later events than the watermark allows dropped (update mode)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        import pandas as pd

        at, nodes = state.get if state.exists else (None, [])
        for batch in batches:
            for when, action, closed in zip(batch["at"], batch["action"], batch["nodes"]):
                when = when.to_pydatetime()
                if at is None or when >= at:
                    at, nodes = when, sorted({int(x) for x in closed}) if action == "close" and closed is not None else []
        state.update((at, nodes))
        yield pd.DataFrame({"graph_id": [key[0]], "at": [at], "nodes": [nodes]})

    watched = events.withWatermark("at", delay)
    return watched.groupBy("graph_id").applyInPandasWithState(step, STATE, "at timestamp, nodes array<long>", "update", GroupStateTimeout.NoTimeout)
