"""citeframe: site audits, answer evaluation and search validation as Spark jobs."""

__version__ = "0.1.0"
