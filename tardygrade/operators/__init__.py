"""DataFrame operators, grouped by what they are used for."""
