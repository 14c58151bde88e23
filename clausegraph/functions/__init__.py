"""Column functions: text normalisation, identifiers, number and date parsing."""
