"""Query plans: derived fixtures, registered queries and their SQL oracles."""
