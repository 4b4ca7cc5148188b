"""Panel operators, one module per family."""
