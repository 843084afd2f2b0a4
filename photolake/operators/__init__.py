"""DataFrame to DataFrame operators of the catalog and of cell tables."""
