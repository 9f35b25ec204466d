"""DataFrame operators over observations and bars."""
