"""Data-quality checks, masking, gold products, alerting and lineage as Spark plans."""
