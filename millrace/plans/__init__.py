"""Query plans composed from the operators, and their registry."""
