"""velado: finds, numbers, masks and restores sensitive values in text corpora on Apache Spark."""

__version__ = "0.1.0"
