"""Query plans over the shared tables."""
