"""idforge: document identifiers, retrieval evaluation and corpus preparation on Spark."""

__version__ = "0.1.0"
