"""Tables, feeds and the mapping of the test tables."""
