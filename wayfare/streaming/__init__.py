"""Nothing here streams: a graph's edges and vertices are batch tables, queries run over a snapshot of them."""
