"""Cell-level expressions."""
