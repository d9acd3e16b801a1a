import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    from tidewheel.session import build_session, ship

    s = build_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__default__parallelism="4")
    ship(s)
    yield s
    s.stop()


def _quarters():
    """Firms of unequal length of life over 20 quarters, with what real panels hold: ties, nulls, NaN, gaps and a date with one firm."""
    import random

    draw = random.Random(20_11)
    sectors = ("mining", "retail", "ships", None)
    for firm in range(43):
        level, born = draw.gauss(0, 1.4), draw.randrange(0, 6)
        for quarter in range(born, 20):
            if draw.random() < 0.08 or quarter == 13:  # gaps; nobody reports in one quarter
                continue
            day = dt.date(2003 + quarter // 4, 3 * (quarter % 4) + 2, 17)
            factor = round(level + draw.gauss(0, 0.5), 1)  # one digit: many ties
            ret = 0.4 * factor / 10 + draw.triangular(-0.2, 0.25, 0.02)
            size = draw.choice([None, 0.0, -3.0]) if draw.random() < 0.05 else draw.paretovariate(1.2) * 50
            yield day, f"firm-{firm}", sectors[firm % 4], size, draw.choice([None, float("nan")]) if draw.random() < 0.06 else factor, None if quarter == 19 else ret
    yield dt.date(2009, 1, 5), "firm-0", "mining", 12.5, 0.3, 0.01


@pytest.fixture(scope="session")
def panel(spark):
    """A panel (date, entity, industry, cap, factor, ret), cached."""
    return spark.createDataFrame(list(_quarters()), "date date, entity string, industry string, cap double, factor double, ret double").cache()
