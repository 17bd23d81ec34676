"""Column functions: geometry and text."""
