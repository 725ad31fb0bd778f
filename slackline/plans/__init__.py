"""Sessions, scratch tables and the registered queries."""
