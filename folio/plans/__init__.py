"""Plans: what would be done with each document, before anything is written."""
