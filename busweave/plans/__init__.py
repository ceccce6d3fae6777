"""Query registry over the driver tables and the end-to-end plan."""
