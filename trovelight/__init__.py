"""trovelight: hybrid document retrieval and ingest as PySpark DataFrame operators."""

from trovelight.settings import Settings

__all__ = ["Settings"]
