"""Column functions the operators are made of."""
