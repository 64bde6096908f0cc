"""Column functions on bits, and running sums."""
