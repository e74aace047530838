"""Part of the code-graph, code-search and supply-chain analytics library."""
