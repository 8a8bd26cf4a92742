"""Column expressions: every function here returns a ``Column``, nothing runs."""
