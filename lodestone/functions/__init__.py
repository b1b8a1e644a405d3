"""Column expressions and model adapters."""
