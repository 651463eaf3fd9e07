"""Tables: the catalog with its case-insensitive names, and the system table."""
