"""Extractors: from file text to nodes, edges and unresolved references, one table function over files."""
