"""Session helpers and the query plans built from the operators."""
