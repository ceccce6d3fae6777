"""Column functions: geography, time, text."""
