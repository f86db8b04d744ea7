"""Reading sources, and writing what jobs produce."""
