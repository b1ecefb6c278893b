"""Column functions over sequences, qualities and record names."""
