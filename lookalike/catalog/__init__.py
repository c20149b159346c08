"""Every operator as a query on the given tables, with SQL to check it."""
