"""Reports over event, session and failure tables, and the registered queries."""
