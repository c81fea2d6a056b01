"""Column functions: native expressions, and Arrow kernels where an algorithm is sequential."""
