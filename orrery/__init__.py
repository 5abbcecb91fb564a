"""orrery: subspace clustering and spatio-temporal analytics on PySpark."""
