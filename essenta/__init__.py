"""essenta: drug-response and gene-essentiality analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames. Matrices are long tables
``(sample, gene, value)``; a missing measurement is an absent row.
"""

__version__ = "0.1.0"
