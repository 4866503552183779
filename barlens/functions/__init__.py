"""Column-level building blocks: null-safe logic, windows, recurrences, medians."""
