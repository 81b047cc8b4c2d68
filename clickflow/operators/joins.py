"""Joins of event rows with per-session tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickflow.schema import SESSION


def by_session(events: DataFrame, per_session: DataFrame, how: str) -> DataFrame:
    """Join on the session key so that AQE can split a hot session.

    A per-session table is mostly an aggregate that is already partitioned by the key; joined as
    it is, it has no exchange of its own and AQE's skew rule does not apply. Joining on a 64-bit hash of the key
    and the key itself gives both sides an exchange (the per-session side is small), and a session
    that holds much of the events is dealt over several tasks. Small sides are broadcast as ever. Null keys
    match nothing.
    """
    mark, key = "_session_hash", "_session_key"
    left = events.withColumn(mark, F.xxhash64(SESSION))
    right = per_session.withColumn(key, F.col(SESSION)).drop(SESSION).withColumn(f"{mark}_2", F.xxhash64(key))
    same = (F.col(mark) == F.col(f"{mark}_2")) & (F.col(SESSION) == F.col(key))
    return left.join(right, same, how).drop(mark, f"{mark}_2", key)
