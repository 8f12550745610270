"""Reports and exchange formats; each takes small result tables."""
