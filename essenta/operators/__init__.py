"""Table-in / table-out operators, one module per operator family."""
