"""From a schema and a query to a pruned read schema and columns."""
