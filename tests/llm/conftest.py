import pytest


@pytest.fixture(autouse=True)
def _on_path(spark):
    """Workers find the package wherever pytest was started."""
    from pathlib import Path

    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2])
