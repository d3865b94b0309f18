"""stridemap: Wi-Fi walk analytics (and training-data operators in ``stridemap.llm``) on Spark."""

__version__ = "0.1.0"
