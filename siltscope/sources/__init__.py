"""Sources: project folders and the pattern catalogue."""
