"""Training-data operators: scans, deduplication, scoring, tokens, packing, formatting and their registered queries."""
