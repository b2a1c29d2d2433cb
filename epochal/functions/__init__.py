"""Column functions and small driver-side formats."""
