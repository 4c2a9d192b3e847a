"""Control tables derived from the test tables, the registered queries and their SQL."""
