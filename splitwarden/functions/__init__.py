"""Column expressions. Everything here is a pure Column -> Column function."""
