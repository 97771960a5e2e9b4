"""Column functions: every one takes and returns a Column and stays inside the JVM."""
