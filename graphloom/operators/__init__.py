"""Query operators: filters, projections, traversals, grouping, ordering, terminals."""
