"""Column functions: language registry, lexing expressions, edit distance."""
