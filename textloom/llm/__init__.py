"""Training-data pipeline operators: ten components that run over whole document and page tables."""
