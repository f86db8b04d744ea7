"""Small functions that the operators share."""
