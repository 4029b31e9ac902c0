"""operators of lodestrand."""
