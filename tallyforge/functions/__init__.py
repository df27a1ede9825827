"""Column expressions and functions of plain values; registry.register() puts them at hand in SQL."""
