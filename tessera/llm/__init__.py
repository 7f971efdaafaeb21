"""Training-data operators: each module is one operator, ``queries`` registers the thin per-contract queries."""
