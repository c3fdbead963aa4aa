"""Content identification on Spark: fingerprints, exact hashes and composite codes as columns."""

__version__ = "0.1.0"
