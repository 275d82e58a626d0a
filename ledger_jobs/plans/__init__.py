"""Jobs: bindings of given tables to the library's inputs, registered queries and their SQL."""
