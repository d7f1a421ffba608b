"""DataFrame operators: filters, tiling, joins, retrieval, fusion, reranking, metrics."""
