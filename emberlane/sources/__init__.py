"""Sources: evidence as JSON lines, and binary artifacts through Spark's binaryFile reader."""
