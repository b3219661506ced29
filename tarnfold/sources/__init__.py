"""Sources and sinks: source trees, the stored catalog, notes, sessions and skills."""
