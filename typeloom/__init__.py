"""typeloom: corpus-scale text linting, normalization and curation on Spark."""

__version__ = "0.1.0"
