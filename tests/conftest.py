import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vecsnap import local_session

    session = local_session(8, "vecsnap-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors(spark):
    return spark.read.parquet(f"{DATA}/embeddings.parquet").cache()


@pytest.fixture(scope="session")
def matrix(vectors):
    import numpy as np

    rows = vectors.orderBy("vec_id").select("embedding").collect()
    return np.array([r[0] for r in rows], dtype=float)
