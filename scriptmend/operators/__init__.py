"""DataFrame operators: sequences, context indexes, retrieval, candidates, fusion, metrics, validation."""
