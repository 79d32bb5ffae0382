import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from corelev.session import get_session

    s = get_session("local[4]", 8)
    yield s


def iris_like(seed=0):
    """Deterministic 150 x 4 three-cluster table standing in for iris (not available offline)."""
    rng = np.random.default_rng(seed)
    centers = np.array([[5.0, 3.4, 1.5, 0.2], [5.9, 2.8, 4.3, 1.3], [6.6, 3.0, 5.6, 2.0]])
    sds = np.array([[0.35, 0.38, 0.17, 0.1], [0.5, 0.3, 0.47, 0.2], [0.63, 0.32, 0.55, 0.27]])
    X = np.vstack([centers[c] + sds[c] * rng.standard_normal((50, 4)) for c in range(3)])
    label = np.repeat([0, 1, 2], 50)
    return X, label


@pytest.fixture(scope="session")
def iris():
    return iris_like()
