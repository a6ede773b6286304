"""Column functions: everything here maps columns to columns inside the JVM unless its name ends in ``_exact``."""
