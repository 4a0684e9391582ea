"""DataFrame operators: index, ranking, fusion, themes."""
