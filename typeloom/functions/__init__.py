"""Column-level functions: characters, patterns, matches and their positions."""
