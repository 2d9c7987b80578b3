"""The registered queries on the given tables, and the SQL they are checked against."""
