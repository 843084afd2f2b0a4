"""Spark jobs for very large photo archives: a catalog, pixel maths on cell tables, and corpus operators."""
