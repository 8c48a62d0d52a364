"""fillgauge: judge how well missing values in large record tables are filled in.

Every operator takes and returns DataFrames.  Row-level work stays in built-in
column functions; the driver only ever sees scalars and size-checked tables.
"""
