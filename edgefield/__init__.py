"""Capture-condition analytics on Spark: where a perception pipeline stops being trustworthy, and what data it needs."""
