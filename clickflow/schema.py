"""Event schema and fixed constants of the session feature model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the modelled behaviour.
# Event vocabulary, in the order its count columns appear.
EVENT_TYPES = ("VIEW", "ADD_CART", "REMOVE_CART", "BUY")
# Added to every denominator of a ratio feature.
EPS = 1e-8
# Folds and seed of the cross-fit.
N_FOLDS = 5
SEED = 42
# Size of the feature ranking kept for the model.
TOP_N_FEATURES = 25

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType(), False),
        T.StructField("event_time", T.TimestampNTZType(), False),
        T.StructField("event_type", T.StringType(), True),
        T.StructField("product_id", T.LongType(), True),
        T.StructField("category_id", T.LongType(), True),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("user_session", T.StringType(), False),
        T.StructField("session_value", T.DoubleType(), True),
        T.StructField("split", T.StringType(), False),
    ]
)

# Same columns with event_time still as text, as a CSV export carries it.
RAW_EVENT_SCHEMA = T.StructType(
    [
        f if f.name != "event_time" else T.StructField("event_time", T.StringType(), True)
        for f in EVENT_SCHEMA.fields
    ]
)

SESSION = "user_session"
LABEL = "session_value"
SPLITS = ("train", "test")
