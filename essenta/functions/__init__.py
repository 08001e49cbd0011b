"""Column functions and probability tails."""
