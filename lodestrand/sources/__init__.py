"""sources of lodestrand."""
