"""Configuration: what a mapping, an ontology, a rule or a constraint says. No data is touched here."""
