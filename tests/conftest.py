import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from habitloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, "tests", {"spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events from ``{(corpus, sequence): [(day, slot, device, action), …]}``."""
    def build(sequences):
        rows = [
            (corpus, name, pos, *quad)
            for (corpus, name), quads in sequences.items() for pos, quad in enumerate(quads)
        ]
        return spark.createDataFrame(
            rows, "corpus_id string, seq_id string, pos int, day int, hour_slot int, device_id int, action_id int",
        )

    return build


@pytest.fixture(scope="session")
def random_events(make_events):
    """Sixty short random sequences of six devices in two corpora, as (table, dict)."""
    import random

    rng = random.Random(5)
    sequences = {}
    for i in range(60):
        quads = []
        for _ in range(rng.randint(1, 9)):
            device = rng.choice([0, 0, 0, 1, 2, 3, 4, 10])
            quads.append((rng.randint(0, 6), rng.randint(0, 7), device, device * 4 + rng.randint(0, 3)))
        sequences[("a" if i % 2 else "b", f"s{i}")] = quads
    return make_events(sequences), sequences
