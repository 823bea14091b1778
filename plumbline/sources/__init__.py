"""Tables, constraints and records of query pairs."""
