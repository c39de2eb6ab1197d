"""Session and registered queries."""
