"""The registered queries and their twins in SQL."""
