"""Column functions: no joins, no shuffles, all inside generated code."""
