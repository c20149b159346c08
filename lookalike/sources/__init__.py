"""Image files, stored tables and generated rows."""
