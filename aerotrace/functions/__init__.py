"""Column to column functions: geometry, boxes, rotations, vectors, text."""
