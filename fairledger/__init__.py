"""Data quality and duplicate detection for procurement master data, as Spark jobs."""
