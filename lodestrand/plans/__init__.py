"""plans of lodestrand."""
