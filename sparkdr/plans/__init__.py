"""Configuration, end-to-end plans and registered queries."""
