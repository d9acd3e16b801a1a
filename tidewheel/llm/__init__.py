"""Operators for training data: sketches, top-N, tokens, mixing and spam pages. Nothing else imports this subpackage."""
