"""A PySpark analytics engine for deterministic procedural memory."""
