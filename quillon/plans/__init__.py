"""SQL over the virtual table keys, and the registered queries."""
