"""Column expressions over sequences, packed k-mers and numbers."""
