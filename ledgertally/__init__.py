"""Public-ledger analytics as plain Spark DataFrame functions."""
