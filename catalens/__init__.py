"""Search and analytics over versioned file-metadata catalogues, as Spark plans."""

__version__ = "0.1.0"
