"""Column expressions of the engine; all run in the JVM unless a module says otherwise."""
