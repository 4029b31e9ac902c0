"""functions of lodestrand."""
