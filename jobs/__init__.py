"""Jobs over the given tables, each with a command line and a configuration file."""
