"""Measures of disclosure risk and of analytic utility, over DataFrames."""
