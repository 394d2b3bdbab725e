"""Physical layouts of a graph. All give the same answers."""
