"""Training-data operators. Nothing outside this package imports it; its queries are listed in ``llm.queries``."""
