"""A snapshot lake for Spark: versioned directory trees as content-addressed tables, and the queries over them."""
