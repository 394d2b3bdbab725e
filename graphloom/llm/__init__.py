"""Training-data operators. Nothing else in graphloom imports this subpackage."""
