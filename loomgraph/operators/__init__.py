"""Graph operators: build, upkeep, lookup, traversal, aggregates, usage, indexing."""
