"""Data processing semantics of a tiered key-value cache and its log store, as Spark programs."""
