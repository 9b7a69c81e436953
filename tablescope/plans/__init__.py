"""Plans: bindings of the operators to concrete tables, and the query registry."""
