"""Column functions shared by the operators; all of them are built-in expressions."""
