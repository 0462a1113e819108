"""Drawing reconciliation on Spark: readers, matching, comparison, reports, OCR scoring."""
