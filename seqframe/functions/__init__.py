"""Column expressions over one sequence, spectrum or pair of sequences."""
