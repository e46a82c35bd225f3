"""navspark: portfolio valuation and account views as Spark DataFrame jobs."""

__version__ = "0.1.0"
