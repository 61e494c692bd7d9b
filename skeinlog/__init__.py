"""skeinlog: analytics over assistant conversation logs, expressed with the DataFrame and SQL API."""
