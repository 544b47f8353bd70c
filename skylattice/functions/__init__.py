"""Column functions: geometry, pixelisation, cosmology and statistics."""
