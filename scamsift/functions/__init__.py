"""Column functions: text, links and domains."""
