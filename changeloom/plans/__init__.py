"""Plans: change logs derived from tables, and the registered queries with their SQL."""
