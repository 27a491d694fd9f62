"""A versioned, ordered key-value store and its analytics, as DataFrame plans over a mutation log."""
