"""Ready-made logs over the test tables and the registered queries."""
