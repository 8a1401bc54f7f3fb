import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from gridmark.session import local_session

    session = local_session(
        "*", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    """Collected tuples of the given columns (all by default)."""
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]
