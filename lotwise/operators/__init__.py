"""Table operators: joins, aggregates, windows, selection, evidence and economics."""
