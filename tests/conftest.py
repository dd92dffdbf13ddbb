import sys
from datetime import date, timedelta
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for entry in (str(ROOT), str(ROOT / "tests")):
    if entry not in sys.path:
        sys.path.insert(0, entry)

from tidemark.session import local_session  # noqa: E402

SERIES_SCHEMA = ("level string, entity string, channel string, ds date, "
                 "revenue decimal(28,4), spend decimal(28,4)")
FACT_SCHEMA = ("channel string, campaign_type string, campaign_name string, ds date, "
               "revenue decimal(18,4), spend decimal(18,4)")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tidemark-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


def money(v):
    return Decimal(str(round(float(v), 4)))


@pytest.fixture(scope="session")
def make_series(spark):
    """Daily series from lists of (revenue, spend), one slice per given name."""
    def build(slices, start=date(2024, 1, 1), level="channel"):
        rows = []
        for entity, days in slices.items():
            lv = "aggregate" if entity == "all" else level
            rows += [(lv, entity, None if lv == "aggregate" else entity, start + timedelta(days=i),
                      money(r), money(s)) for i, (r, s) in enumerate(days)]
        return spark.createDataFrame(rows, SERIES_SCHEMA)
    return build


@pytest.fixture(scope="session")
def make_facts(spark):
    def build(rows):
        return spark.createDataFrame(
            [(c, t, n, d if d is None or isinstance(d, date) else date.fromisoformat(d), money(r), money(s))
             for c, t, n, d, r, s in rows], FACT_SCHEMA)
    return build
