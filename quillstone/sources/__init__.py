"""Where entities and their schemas come from: schema folders, tables, CSV files."""
