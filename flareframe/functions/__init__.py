"""Column functions: labels, names, arrays, decoding and skill-score arithmetic."""
