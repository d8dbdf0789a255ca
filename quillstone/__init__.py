"""Loan-panel, cash-flow and training-corpus analytics on Spark DataFrames."""
