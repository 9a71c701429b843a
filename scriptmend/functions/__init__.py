"""Column functions over text, arrays and numbers."""
