"""Operators for training text at corpus scale, one module per problem (p1 to p10)."""
