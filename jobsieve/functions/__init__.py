"""Column-to-column helpers; everything here stays inside the JVM unless noted."""
