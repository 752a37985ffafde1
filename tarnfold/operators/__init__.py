"""The fixed-point operator, its residuals and norms, and the solvers."""
