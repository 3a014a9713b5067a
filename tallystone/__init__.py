"""Brokerage-ledger analytics expressed as Spark DataFrame functions."""
