"""Column functions: sequences, coordinates, CIGAR strings, qualities, flags and scores."""
