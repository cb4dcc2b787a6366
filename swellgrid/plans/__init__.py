"""Multi-step analyses and the registered queries."""
