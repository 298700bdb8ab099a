"""End-to-end plans (search, find-related, indexing, evaluation) and the registered queries."""
