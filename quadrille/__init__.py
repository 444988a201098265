"""Quadrille: hierarchical grid-cell analytics expressed as Spark DataFrame plans."""
