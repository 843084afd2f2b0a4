"""Column functions: no shuffle, all inside generated code."""
