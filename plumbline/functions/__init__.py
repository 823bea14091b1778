"""Types, functions and the columns they become."""
