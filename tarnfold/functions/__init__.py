"""Column functions: text, references, signatures, hashes and identifiers."""
