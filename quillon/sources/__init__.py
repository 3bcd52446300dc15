"""Where keyspaces come from and go to."""
