"""Column functions over images held as arrays, and NumPy kernels."""
