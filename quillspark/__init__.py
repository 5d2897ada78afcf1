"""A PySpark engine for prose-quality analytics; subpackages are imported on demand."""

__version__ = "0.1.0"
