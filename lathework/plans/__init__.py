"""Plans of the file tools and the registered queries."""
