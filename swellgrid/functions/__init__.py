"""Column functions: flux, energy, revenue, calendar and labels."""
