"""Jobs over the layers, and the registered queries."""
