"""Column functions: boxes, paths, positions on the map."""
