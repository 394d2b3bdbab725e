"""SPARQL text to algebra, and the rewrites before a DataFrame exists."""
