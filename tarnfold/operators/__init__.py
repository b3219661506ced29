"""Relational operators: chunking, catalog, selection, rendering, memory, edits, loops, skills."""
