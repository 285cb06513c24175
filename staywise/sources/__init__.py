"""Input tables, logical-table adapters, ingest, stores and exports."""
