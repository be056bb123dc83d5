"""Table bindings and the registered queries with their check SQL."""
