"""Column functions: text normalisation, matching forms, figures."""
