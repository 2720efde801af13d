import math
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from factorloom.session import local_session  # noqa: E402

NAN = float("nan")


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=8, partitions=4)


def rows(df, *order):
    """Rows as tuples, sorted by the named columns (all if none)."""
    found = [tuple(r) for r in df.select(*(order or df.columns), *[c for c in df.columns if order and c not in order]).collect()]
    return sorted(found, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is b
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
