"""Runnable jobs over the library's operators; each is a function of a session, with a command line and a config beside it."""
