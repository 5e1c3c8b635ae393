"""Part of corpuslode."""
