"""Column functions: ``expr(col, ...) -> Column``, all JVM-side."""
