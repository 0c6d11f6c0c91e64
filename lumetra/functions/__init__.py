"""Column functions: optics, units and names. No Python runs per row."""
