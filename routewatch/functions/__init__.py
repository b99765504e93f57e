"""Column functions: addresses, AS paths, classes and display formats."""
