"""Column functions: scalar semantics, always inside code generation."""
