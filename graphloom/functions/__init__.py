"""Column functions on RDF terms and SPARQL expressions."""
