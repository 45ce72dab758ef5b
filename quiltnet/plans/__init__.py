"""Query plans over the supplied tables, and how long plans are cut."""
