"""Column-level building blocks: fixed values, calendar, predicates, text."""
