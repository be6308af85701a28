"""Jobs that run by themselves: each has a command line, a settings file, and a function that takes a session."""
