"""DataFrame -> DataFrame operators (flatten, keys, normalise, predicates, ...)."""
