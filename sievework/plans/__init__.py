"""Compositions of operators, one module per pipeline or report."""
