"""Column functions: text views, check digits, value builders, key formats."""
