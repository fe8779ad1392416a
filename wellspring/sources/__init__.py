"""Table readers, writers and the views the registered queries start from."""
