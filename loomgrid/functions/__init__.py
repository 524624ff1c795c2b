"""Column functions: geometry, affine transforms, tile weights, radiometry."""
