"""Column functions: times, signatures of nodes, whole-text matching."""
