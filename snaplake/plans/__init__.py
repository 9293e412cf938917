"""Plans over the sample tables: a fixture repository, and one query for each operator with its SQL."""
