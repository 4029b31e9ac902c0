"""streaming of lodestrand."""
