"""Column functions: tokens, path parts, score, labels."""
