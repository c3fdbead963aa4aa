"""Array kernels: NumPy in, NumPy or bytes out. No Spark here."""
