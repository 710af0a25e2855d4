"""Column expressions: vectors and sequences, quaternions and poses, summary statistics."""
