import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from folium.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("folium-tests", cores=4, partitions=4)
