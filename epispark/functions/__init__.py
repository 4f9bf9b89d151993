"""Column builders: everything here returns Columns and stays inside the JVM unless noted."""
