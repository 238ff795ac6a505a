"""Column builders: geometry, colours, names."""
