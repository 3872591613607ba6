"""Reading, schema reconciliation and writing."""
