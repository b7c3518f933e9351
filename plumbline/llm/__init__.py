"""Training-data operators: ten standalone modules, one per operator, plus the queries over the sample tables."""
