"""Operators on entity tables: filters, sorting and paging, projection, relations, search, layouts, changes, validation."""
