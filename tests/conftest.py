import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from clickflow.config import local_session  # noqa: E402
from clickflow.schema import EVENT_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("*", 8, app="clickflow-tests")


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


@pytest.fixture(scope="session")
def make_events(spark):
    """Rows: (event_id, time text, type, product, category, user, session[, value, split])."""

    def make(rows):
        full = []
        for r in rows:
            r = list(r)
            if len(r) == 7:
                r += [10.0, "train"]
            r[1] = ts(r[1])
            full.append(tuple(r))
        return spark.createDataFrame(full, EVENT_SCHEMA)

    return make
