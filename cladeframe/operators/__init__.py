"""The analytic operators, each a composition of DataFrame operations."""
