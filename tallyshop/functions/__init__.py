"""Column expressions and the scalable building blocks the operators share."""
