import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_helpers import frame, odd_texts  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts under distinct ids."""
    return frame(spark, odd_texts())


@pytest.fixture(scope="session")
def repeated(spark):
    """Odd texts, some rows twice, one id for two texts, two rows without an id."""
    t = odd_texts()
    return frame(spark, [*t, t[0], t[4], "another text of id 3", "nobody's", None], ids=[*range(len(t)), 0, 4, 3, None, None])


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
