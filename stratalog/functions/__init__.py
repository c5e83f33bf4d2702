"""Column functions: vector clocks, paths and text."""
