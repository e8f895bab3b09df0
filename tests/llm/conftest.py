import pytest

from tenderloom.llm.tables import bounded_batches


@pytest.fixture(autouse=True)
def _bounded(request):
    if "spark" in request.fixturenames:
        bounded_batches(request.getfixturevalue("spark"))
